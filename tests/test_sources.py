"""File formats, projections and grids: round trips, files made here, published examples."""

import struct
import zlib
from datetime import datetime

import numpy as np
import pytest

from rainweft.errors import DataModelError
from rainweft.functions import projections
from rainweft.operators import reprojection
from rainweft.sources import geotiff, grib2, netcdf3, rasters, sinks

META = {"projection": "+proj=stere +lat_0=90 +lat_ts=60 +lon_0=10 +ellps=WGS84", "x1": -1000.0, "y1": -3000.0, "xpixelsize": 1000.0, "ypixelsize": 500.0, "yorigin": "upper", "unit": "mm/h", "accutime": 5.0, "institution": "here"}


def test_published_points_of_projections():
    laea = projections.Projection("+proj=laea +lat_0=52 +lon_0=10 +x_0=4321000 +y_0=3210000 +ellps=GRS80")
    assert np.allclose(laea.forward(5, 50), (3962799.45, 2999718.85), atol=0.01)
    polar = projections.Projection("+proj=stere +lat_0=90 +lon_0=0 +k_0=0.994 +x_0=2000000 +y_0=2000000")
    assert np.allclose(polar.forward(44, 73), (3320416.75, 632668.43), atol=0.01)


@pytest.mark.parametrize("text", ["+proj=lcc +lat_1=49 +lat_2=44 +lat_0=46.5 +lon_0=3 +x_0=700000 +ellps=GRS80", "+proj=aea +lat_1=29.5 +lat_2=45.5 +lat_0=37.5 +lon_0=-96", "+proj=merc +lon_0=5", "+proj=stere +lat_0=90 +lat_ts=60 +R=6370040", "+proj=laea +lat_0=90 +lon_0=10 +R=6370040", "+proj=stere +lat_0=90 +lat_ts=60 +units=km"])
def test_projections_invert(text):
    lon, lat = np.meshgrid(np.linspace(-20, 30, 7), np.linspace(35, 70, 6))
    p = projections.Projection(text)
    back = p.inverse(*p.forward(lon, lat))
    assert np.allclose(back[0], lon, atol=1e-9) and np.allclose(back[1], lat, atol=1e-9)


def test_grid_mappings():
    text = "+proj=stere +lat_0=90.0 +lat_ts=60.0 +lon_0=10.0 +x_0=1.0 +y_0=2.0"
    assert projections.from_grid_mapping(projections.to_grid_mapping(text)) == projections.from_grid_mapping(projections.to_grid_mapping(projections.from_grid_mapping(projections.to_grid_mapping(text))))
    assert projections.to_grid_mapping("+proj=lcc +lat_1=30 +lat_2=50 +lon_0=5")["standard_parallel"] == [30.0, 50.0]
    assert projections.to_grid_mapping("+proj=merc") is None and projections.from_grid_mapping({"grid_mapping_name": "none"}) is None
    with pytest.raises(ValueError):
        projections.Projection("+proj=somerc")


def test_netcdf_round_trip_and_packing():
    ds = netcdf3.Dataset(attrs={"title": "é"})
    ds.add("t", ("t",), np.arange(3.0), units="minutes")
    ds.add("v", ("t", "x"), np.array([[1, 2, 3], [4, 5, 6], [7, 8, 9]], "i2"), scale_factor=0.5, add_offset=1.0, _FillValue=np.int16(5))
    ds.add("none", (), np.array(0, "i4"), label="x", number=2.5)
    got = netcdf3.loads(netcdf3.dumps(ds))
    assert got.attrs == {"title": "é"} and got.dims == {"t": 3, "x": 3} and got.variables["none"].attrs == {"label": "x", "number": 2.5}
    want = np.arange(1.0, 10).reshape(3, 3) * 0.5 + 1
    want[1, 1] = np.nan
    assert np.array_equal(netcdf3.values(got.variables["v"]), want, equal_nan=True)
    with pytest.raises(ValueError):
        netcdf3.loads(b"HDF")


@pytest.mark.parametrize("bands", [1, 3])
def test_geotiff_round_trip(bands):
    a = np.random.RandomState(1).random_sample((bands, 7, 5))
    a[0, 2, 3] = np.nan
    got, meta = geotiff.loads(geotiff.dumps(a, 100.0, 900.0, 10.0, 20.0, "+proj=longlat"))
    assert np.allclose(got, a, atol=1e-6, equal_nan=True) and (meta["left"], meta["top"], meta["dx"], meta["dy"]) == (100.0, 900.0, 10.0, 20.0) and meta["projection"] == "+proj=longlat"


def png(codes: np.ndarray) -> bytes:
    """A 16-bit greyscale PNG whose rows take each filter in turn."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows, before, out = codes.astype(">u2").view(np.uint8).reshape(len(codes), -1), np.zeros(codes.shape[1] * 2, int), b""
    for y, row in enumerate(rows.astype(int)):
        left, corner = np.concatenate([[0, 0], row[:-2]]), np.concatenate([[0, 0], before[:-2]])
        p = left + before - corner
        d = np.stack([abs(p - left), abs(p - before), abs(p - corner)])
        paeth = np.choose(np.argmin(d, 0), [left, before, corner])
        guess = [0 * row, left, before, (left + before) // 2, paeth][y % 5]
        out += bytes([y % 5]) + ((row - guess) % 256).astype(np.uint8).tobytes()
        before = row
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", codes.shape[1], len(codes), 16, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(out)) + chunk(b"IEND", b"")


def grib(codes: np.ndarray, packing: int) -> bytes:
    ny, nx = codes.shape
    section = lambda number, body: struct.pack(">IB", len(body) + 5, number) + body
    grid = b"\0" + struct.pack(">IBBH", nx * ny, 0, 0, 0) + bytes(16) + struct.pack(">II", nx, ny) + bytes(8) + struct.pack(">IIB", 55_000_000, 230_000_000, 48) + struct.pack(">IIII", 50_000_000, 239_000_000, 1_000_000, 1_000_000) + b"\0"
    how = struct.pack(">IH", nx * ny, packing) + struct.pack(">fHHBB", -30.0, 0, 1, 16, 0)
    data = png(codes) if packing == 41 else codes.astype(">u2").tobytes()
    body = section(1, bytes(7) + struct.pack(">HBBBBB", 2020, 1, 2, 3, 4, 5) + bytes(2)) + section(3, grid) + section(4, bytes(29)) + section(5, how) + section(6, b"\xff") + section(7, data)
    return b"GRIB\0\0\0\2" + struct.pack(">Q", 16 + len(body) + 4) + body + b"7777"


@pytest.mark.parametrize("packing", [0, 41])
def test_grib_fields(packing):
    codes = np.random.RandomState(3).randint(0, 60000, (6, 8))
    codes[0, 0] = 0  # -3: missing
    field, meta = grib2.loads(grib(codes, packing))
    assert np.allclose(field, (codes - 30) / 10) and meta["lat1"] == 55.0 and meta["dlon"] == 1.0
    data, _, m = rasters.FORMATS["mrms_grib"](grib(codes, packing), window_size=2)
    assert data.shape == (3, 4) and np.isclose(data[1, 1], ((codes - 30) / 10)[2:4, 2:4].mean()) and np.isclose(data[0, 0], ((codes - 30) / 10)[:2, :2].ravel()[1:].mean())
    assert m["accutime"] == 2.0 and m["x1"] == -130.5 and m["y2"] == 55.5
    part, _, m = rasters.FORMATS["mrms_grib"](grib(codes, packing), window_size=1, extent=(-130.0, -128.0, 52.0, 54.0))
    assert part.shape == (3, 3) and np.isclose(part[0, 0], (codes[1, 0] - 30) / 10)
    with pytest.raises(DataModelError):
        rasters.FORMATS["mrms_grib"](grib(codes, packing), extent=(0.0, 5.0, 52.0, 54.0))


def test_frames_of_files(spark, tmp_path):
    codes = np.array([[[64, 84, 255], [104, 66, 64]]], float)
    (tmp_path / "202001020304.tif").write_bytes(geotiff.dumps(codes, 0.0, 20.0, 10.0, 10.0, "+proj=longlat"))
    (tmp_path / "202001020309.tif").write_bytes(b"II*\0broken")
    (tmp_path / "202001020409.tif").write_bytes(b"not asked for")
    got = {r.ts.minute: r for r in rasters.read_frames(spark, str(tmp_path), "fmi_geotiff", "%Y%m%d%H%M", "*.tif", (datetime(2020, 1, 2, 3), datetime(2020, 1, 2, 4))).collect()}
    assert sorted(got) == [4, 9] and got[4].data == [0.0, 10.0, None, 20.0, 1.0, 0.0] and got[4].error is None and got[4].meta.y2 == 20.0
    assert got[9].data is None and got[9].error
    assert rasters.read_frames(spark, str(tmp_path), "fmi_geotiff", "%Y%m%d%H%M", "*.tif", (datetime(2021, 1, 1), datetime(2021, 1, 2))).count() == 0


def test_odim_groups():
    what = {"gain": 0.5, "offset": -32.0, "nodata": 255.0, "undetect": 0.0, "quantity": "DBZH"}
    tree = {
        "attrs": {}, "what": {"attrs": {"source": "NOD:xx"}},
        "where": {"attrs": {"projdef": "+proj=laea +lat_0=55 +lon_0=10", "LL_lon": 5.0, "LL_lat": 50.0, "UR_lon": 15.0, "UR_lat": 60.0, "xscale": 2000.0, "yscale": 2000.0}},
        "how": {"attrs": {"zr_a": 223.0, "zr_b": 1.53}},
        "dataset1": {
            "attrs": {}, "what": {"attrs": {"startdate": "20200101", "starttime": "000000", "enddate": "20200101", "endtime": "001500"}},
            "data1": {"attrs": {}, "what": {"attrs": what}, "data": np.array([[0, 255], [64, 104]])},
            "quality1": {"attrs": {}, "what": {"attrs": {"gain": 0.1}}, "data": np.array([[1, 2], [3, 4]])},
        },
    }
    data, quality, meta = rasters.odim_field(tree, "DBZH", lambda q, offset: -30.0)
    assert data[0, 0] == -30 and np.isnan(data[0, 1]) and data[1].tolist() == [0.0, 20.0] and np.allclose(quality, [[0.1, 0.2], [0.3, 0.4]])
    assert meta["accutime"] == 15.0 and meta["zr_a"] == 223.0 and meta["x1"] < 0 < meta["x2"] and meta["unit"] == "dBZ" and meta["institution"] == "NOD:xx"
    with pytest.raises(ValueError):
        rasters.odim_field(tree, "RATE", lambda q, offset: None)


def test_netcdf_readers():
    ds = netcdf3.Dataset()
    ds.add("yc", ("y",), np.array([30.0, 20.0, 10.0]), units="km")
    ds.add("xc", ("x",), np.array([1.0, 2.0, 3.0, 4.0]), units="km")
    ds.add("start_time", (), np.array(600.0), units="seconds")
    ds.add("valid_time", (), np.array(1200.0), units="seconds")
    ds.add("precipitation", ("y", "x"), np.arange(12.0).reshape(3, 4).astype("f4"), _FillValue=np.float32(5))
    data, _, meta = rasters.FORMATS["bom_rf3"](netcdf3.dumps(ds))
    assert np.isnan(data[1, 1]) and meta["accutime"] == 10.0 and meta["unit"] == "mm" and (meta["x1"], meta["y2"], meta["ypixelsize"]) == (500.0, 35000.0, 10000.0)
    part, _, m = rasters.FORMATS["bom_rf3"](netcdf3.dumps(ds), extent=(1400.0, 3400.0, 6000.0, 26000.0))
    assert part.tolist()[1] == [9.0, 10.0] and m["x1"] == 1500.0 and m["y2"] == 25000.0


def forecast(spark):
    rows = [(1, m, float(k), 2, 3, [float(m), k * 10.0, None, 1.0, 2.0, 3.5]) for m in range(3) for k in (1, 2)]
    return spark.createDataFrame(rows, "case int, member int, lead double, ny int, nx int, data array<double>")


@pytest.mark.parametrize("incremental, files", [(None, 1), ("timestep", 2), ("member", 3)])
@pytest.mark.parametrize("packing", [None, (0.5, 0.0)])
def test_forecast_files_round_trip(spark, tmp_path, incremental, files, packing):
    df = forecast(spark)
    sinks.write_forecast(df, str(tmp_path / "n"), "netcdf", incremental, start=datetime(2020, 1, 1), meta=META, packing=packing)
    assert len(list((tmp_path / "n").glob("*.nc"))) == files and not list((tmp_path / "n").glob(".*"))
    got = sorted((r.member, r.lead / 5, r.data) for r in sinks.read_forecast_files(spark, str(tmp_path / "n")).collect())
    assert got == sorted((r.member, r.lead, r.data) for r in df.collect())


def test_forecast_tiffs(spark, tmp_path):
    sinks.write_forecast(forecast(spark), str(tmp_path / "g"), "geotiff", start=datetime(2020, 1, 1), meta=META)
    names = sorted(p.name for p in (tmp_path / "g").glob("*.tif"))
    assert names == ["nowcast-1_202001010000_005.tif", "nowcast-1_202001010000_010.tif"]
    bands, meta = geotiff.loads((tmp_path / "g" / names[1]).read_bytes())
    assert bands.shape == (3, 2, 3) and bands[2, 0, :2].tolist() == [2.0, 20.0] and np.isnan(bands[0, 0, 2]) and meta["top"] == -2000.0
    with pytest.raises(ValueError):
        sinks.write_forecast(forecast(spark), str(tmp_path / "h"), "geotiff", "member")


def test_reprojected_grids(spark):
    polar = META | {"x1": -2000.0, "y1": -4000.0}
    lon, lat = projections.Projection(META["projection"]).inverse(np.array([-1500.0, 500.0]), np.array([-2250.0, -3750.0]))
    assert np.isfinite(lon).all() and np.isfinite(lat).all()
    src = spark.createDataFrame([(0, 4, 3, [float(k) if k != 7 else None for k in range(12)])], "t int, ny int, nx int, data array<double>")
    same = reprojection.reproject_grids(src, polar, polar, (4, 3)).first()
    assert same.data == [float(k) if k != 7 else None for k in range(12)]
    shifted = reprojection.reproject_grids(src, polar, polar | {"x1": -1000.0}, (4, 3)).first()
    assert shifted.data[:3] == [1.0, 2.0, None]
    there = {"projection": "+proj=longlat", "x1": -180.0, "y1": 80.0, "xpixelsize": 45.0, "ypixelsize": 2.5, "yorigin": "upper"}
    row, col = reprojection.source_cells(there, polar | {"x1": -1000.0, "y1": -1000.0}, (4, 8), (4, 2))
    assert (row[:, :] == 0).all() and len(set(col.ravel().tolist())) > 2  # around the pole
    assert reprojection.cell_map(spark, polar, polar, (4, 3), (4, 3)).count() == 12
    assert reprojection.reproject_grids(src.limit(0), polar, polar, (4, 3)).count() == 0


def test_fixed_grids():
    assert rasters.SWISS["x2"] - rasters.SWISS["x1"] == 710 * 1000.0
    geo = rasters.polar_geodata(900, 900)
    x, y = projections.Projection(rasters.POLAR).forward(3.5889, 46.9526)
    assert abs(geo["x1"] - x) < 100 and abs(geo["y1"] - y) < 100  # the published corner
    assert "x1" not in rasters.polar_geodata(5, 5)
