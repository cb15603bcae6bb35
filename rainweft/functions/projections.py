"""Map projections of radar grids: strings, grid mappings and the formulas of five of them.

Formulas are those of Snyder's public manual of map projections on an ellipsoid,
vectorised over arrays of degrees and metres.
"""

from __future__ import annotations

import math

import numpy as np

# Semi-major axis (m) and flattening of ellipsoids by name.
ELLIPSOIDS = {"WGS84": (6378137.0, 1 / 298.257223563), "GRS80": (6378137.0, 1 / 298.257222101), "bessel": (6377397.155, 1 / 299.1528128), "intl": (6378388.0, 1 / 297.0), "sphere": (6370997.0, 0.0)}
# Names of projections and of their parameters in grid mappings.
MAPPINGS = {"stere": "polar_stereographic", "aea": "albers_conical_equal_area", "lcc": "lambert_conformal_conic", "laea": "lambert_azimuthal_equal_area"}
_MAPPED = {"lon_0": "straight_vertical_longitude_from_pole", "lat_0": "latitude_of_projection_origin", "lat_ts": "standard_parallel", "x_0": "false_easting", "y_0": "false_northing", "k": "scale_factor_at_projection_origin", "k_0": "scale_factor_at_projection_origin", "a": "semi_major_axis", "b": "semi_minor_axis"}


def parse(text: str) -> dict[str, str]:
    """Parameters of a projection string; one without a value is ``"true"``."""
    out = {}
    for word in (text or "").split():
        name, _, value = word.lstrip("+").partition("=")
        out[name] = value or "true"
    return out


def written(parameters: dict) -> str:
    return " ".join(f"+{k}" if v == "true" else f"+{k}={v}" for k, v in parameters.items())


def to_grid_mapping(text: str) -> dict | None:
    """Name and attributes of the grid mapping of a projection string; None for projections that have none here."""
    p = parse(text)
    name = MAPPINGS.get(p.get("proj", ""))
    if name is None:
        return None
    out: dict = {"grid_mapping_name": name}
    if p["proj"] != "stere":
        parallels = [float(p[k]) for k in ("lat_1", "lat_2") if k in p]
        if parallels:
            out["standard_parallel"] = parallels
    for k, v in p.items():
        key = _MAPPED.get(k)
        if key == "straight_vertical_longitude_from_pole" and p["proj"] != "stere":
            key = "longitude_of_central_meridian" if p["proj"] in ("aea", "lcc") else "longitude_of_projection_origin"
        if key:
            out[key] = float(v)
    return out


def from_grid_mapping(attrs: dict) -> str | None:
    """Projection string of a grid mapping's attributes; None where its name is unknown."""
    kind = {v: k for k, v in MAPPINGS.items()}.get(attrs.get("grid_mapping_name", ""))
    if kind is None:
        return None
    p: dict = {"proj": kind}
    back = {v: k for k, v in _MAPPED.items() if k not in ("k_0", "lat_ts")} | {"longitude_of_central_meridian": "lon_0", "longitude_of_projection_origin": "lon_0"}
    for name, value in attrs.items():
        if name == "standard_parallel":
            each = np.atleast_1d(value).tolist()
            p |= {"lat_ts": each[0]} if kind == "stere" else dict(zip(("lat_1", "lat_2"), each))
        elif name in back:
            p[back[name]] = value
    return written({k: v if isinstance(v, str) else repr(float(v)) for k, v in p.items()})


class Projection:
    """forward: degrees to metres, inverse: metres to degrees. longlat, stere (polar), lcc, aea, laea, merc."""

    def __init__(self, text: str):
        p = parse(text)
        self.kind = p.get("proj", "longlat")
        if self.kind in ("latlong", "latlon", "lonlat"):
            self.kind = "longlat"
        if self.kind not in ("longlat", "stere", "lcc", "aea", "laea", "merc"):
            raise ValueError(f"projection {self.kind} isn't supported")
        number = lambda k, d=0.0: float(p.get(k, d))
        if "R" in p:
            self.a, f = number("R"), 0.0
        elif "a" in p:
            self.a = number("a")
            f = 1 - number("b", self.a) / self.a if "b" in p else 1 / number("rf") if "rf" in p else number("f")
        else:
            self.a, f = ELLIPSOIDS.get(p.get("ellps", p.get("datum", "WGS84")), ELLIPSOIDS["WGS84"])
        self.e2 = f * (2 - f)
        self.e = math.sqrt(self.e2)
        self.x0, self.y0, self.lon0, self.lat0 = number("x_0"), number("y_0"), math.radians(number("lon_0")), math.radians(number("lat_0"))
        self.unit = 1000.0 if p.get("units") == "km" else 1.0
        self.k0 = number("k_0", number("k", 1.0))
        e, a = self.e, self.a
        if self.kind == "stere":
            if abs(abs(self.lat0) - math.pi / 2) > 1e-9:
                raise ValueError("only polar stereographic grids are supported")
            self.sign = 1.0 if self.lat0 > 0 else -1.0
            if "lat_ts" in p and abs(abs(number("lat_ts")) - 90) > 1e-9:
                ts = abs(math.radians(number("lat_ts")))
                self.rho0 = a * self._m(ts) / self._t(ts)
            else:
                self.rho0 = 2 * a * self.k0 / math.sqrt((1 + e) ** (1 + e) * (1 - e) ** (1 - e))
        elif self.kind in ("lcc", "aea"):
            one = math.radians(number("lat_1", p.get("lat_0", 0.0)))
            two = math.radians(number("lat_2", p.get("lat_1", p.get("lat_0", 0.0))))
            m1, m2 = self._m(one), self._m(two)
            if self.kind == "lcc":
                t1, t2 = self._t(one), self._t(two)
                self.n = math.sin(one) if abs(one - two) < 1e-12 else math.log(m1 / m2) / math.log(t1 / t2)
                self.f = m1 / (self.n * t1**self.n)
                self.rho0 = a * self.f * self._t(self.lat0) ** self.n
            else:
                q1, q2 = self._q(one), self._q(two)
                self.n = math.sin(one) if abs(one - two) < 1e-12 else (m1 * m1 - m2 * m2) / (q2 - q1)
                self.c = m1 * m1 + self.n * q1
                self.rho0 = a * math.sqrt(self.c - self.n * self._q(self.lat0)) / self.n
        elif self.kind == "laea":
            self.qp = self._q(math.pi / 2)
            self.rq = a * math.sqrt(self.qp / 2)
            self.beta0 = math.asin(min(1.0, max(-1.0, self._q(self.lat0) / self.qp)))
            polar = abs(math.cos(self.beta0)) < 1e-12
            self.d = 1.0 if polar else a * self._m(self.lat0) / (self.rq * math.cos(self.beta0))
        elif self.kind == "merc":
            self.k = self._m(math.radians(number("lat_ts"))) if "lat_ts" in p else self.k0

    def _m(self, lat):
        return np.cos(lat) / np.sqrt(1 - self.e2 * np.sin(lat) ** 2)

    def _t(self, lat):
        s = self.e * np.sin(lat)
        return np.tan(math.pi / 4 - lat / 2) / ((1 - s) / (1 + s)) ** (self.e / 2)

    def _q(self, lat):
        s = np.sin(lat)
        if self.e == 0:
            return 2 * s
        return (1 - self.e2) * (s / (1 - self.e2 * s * s) - np.log((1 - self.e * s) / (1 + self.e * s)) / (2 * self.e))

    def _lat_of_t(self, t):
        lat = math.pi / 2 - 2 * np.arctan(t)
        for _ in range(8):
            s = self.e * np.sin(lat)
            lat = math.pi / 2 - 2 * np.arctan(t * ((1 - s) / (1 + s)) ** (self.e / 2))
        return lat

    def _lat_of_q(self, q):
        lat = np.arcsin(np.clip(q / 2, -1, 1))
        if self.e == 0:
            return lat
        for _ in range(12):
            s = np.sin(lat)
            w = 1 - self.e2 * s * s
            step = w * w / (2 * np.maximum(np.cos(lat), 1e-12)) * (q / (1 - self.e2) - s / w + np.log((1 - self.e * s) / (1 + self.e * s)) / (2 * self.e))
            lat = np.clip(lat + step, -math.pi / 2, math.pi / 2)
        return lat

    def forward(self, lon, lat) -> tuple[np.ndarray, np.ndarray]:
        lon, lat = np.asarray(lon, float), np.asarray(lat, float)
        if self.kind == "longlat":
            return lon, lat
        d = np.remainder(np.radians(lon) - self.lon0 + math.pi, 2 * math.pi) - math.pi
        lat = np.radians(lat)
        if self.kind == "stere":
            rho = self.rho0 * self._t(self.sign * lat)
            x, y = rho * np.sin(d), -self.sign * rho * np.cos(d)
        elif self.kind == "lcc":
            rho = self.a * self.f * self._t(lat) ** self.n
            x, y = rho * np.sin(self.n * d), self.rho0 - rho * np.cos(self.n * d)
        elif self.kind == "aea":
            rho = self.a * np.sqrt(np.maximum(self.c - self.n * self._q(lat), 0)) / self.n
            x, y = rho * np.sin(self.n * d), self.rho0 - rho * np.cos(self.n * d)
        elif self.kind == "laea":
            beta = np.arcsin(np.clip(self._q(lat) / self.qp, -1, 1))
            b = self.rq * np.sqrt(2 / (1 + math.sin(self.beta0) * np.sin(beta) + math.cos(self.beta0) * np.cos(beta) * np.cos(d)))
            x, y = b * self.d * np.cos(beta) * np.sin(d), b / self.d * (math.cos(self.beta0) * np.sin(beta) - math.sin(self.beta0) * np.cos(beta) * np.cos(d))
        else:
            x, y = self.a * self.k * d, -self.a * self.k * np.log(self._t(lat))
        return (x + self.x0) / self.unit, (y + self.y0) / self.unit

    def inverse(self, x, y) -> tuple[np.ndarray, np.ndarray]:
        x, y = np.asarray(x, float), np.asarray(y, float)
        if self.kind == "longlat":
            return x, y
        x, y = x * self.unit - self.x0, y * self.unit - self.y0
        if self.kind == "stere":
            rho = np.hypot(x, y)
            lat = self.sign * self._lat_of_t(rho / self.rho0)
            d = np.arctan2(x, -self.sign * y)
        elif self.kind in ("lcc", "aea"):
            s = math.copysign(1.0, self.n)
            rho, d = s * np.hypot(x, self.rho0 - y), np.arctan2(s * x, s * (self.rho0 - y)) / self.n
            lat = self._lat_of_t((rho / (self.a * self.f)) ** (1 / self.n)) if self.kind == "lcc" else self._lat_of_q((self.c - (rho * self.n / self.a) ** 2) / self.n)
        elif self.kind == "laea":
            rho = np.hypot(x / self.d, self.d * y)
            c = 2 * np.arcsin(np.clip(rho / (2 * self.rq), -1, 1))
            with np.errstate(invalid="ignore", divide="ignore"):
                q = np.where(rho > 0, self.qp * (np.cos(c) * math.sin(self.beta0) + self.d * y * np.sin(c) * math.cos(self.beta0) / rho), self.qp * math.sin(self.beta0))
            lat = self._lat_of_q(q)
            d = np.arctan2(x * np.sin(c), self.d * rho * math.cos(self.beta0) * np.cos(c) - self.d * self.d * y * math.sin(self.beta0) * np.sin(c))
        else:
            lat, d = self._lat_of_t(np.exp(-y / (self.a * self.k))), x / (self.a * self.k)
        lon = np.degrees(d + self.lon0)
        return np.remainder(lon + 180, 360) - 180, np.degrees(lat)
