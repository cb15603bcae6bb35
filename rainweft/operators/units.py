"""Frames in many units brought to rain rate in mm/h.

Each frame has a set of possible readings of its numbers: a unit, a transform
and, where nobody states it, an accumulation time. Physical identities between
columns give each reading a misfit in log units: depth = rate * time, mass =
density * depth and Z = a * R^b bring the frame's threshold and largest pixel to
mm/h, where the threshold must equal the detection floor of the source and the
dry value must lie below it as it does in frames of that transform. Floors,
distances and usual levels are those of the source's own frames whose readings
are certain (else of its institution, else of all). What metadata and notes
state is evidence too: a reading that contradicts it costs CONTRADICTION log
units, so only a misfit of a factor of a thousand overrules it. The reading of
least total is taken; it isn't unique where another comes as near, where its
misfit is large, or where it contradicts a statement.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rainweft.workspace import require, written

ZR = (200.0, 1.6)
CLOSE = 0.02  # log10 units: readings so near are no decision
TOLERANCE = 0.01  # log10 units: a larger misfit is never unique
CONTRADICTION, SILENCE = 3.0, 0.5  # of a reading against a statement; of a transform that nobody mentions beside a stated unit
LEAST_SPREAD = 0.3  # log10 units of the usual levels of a source
LEVEL = 0.01  # weight of the squared distance from the usual level, which decides ties only
TIMES = (1.0, 2.0, 2.5, 3.0, 4.0, 5.0, 6.0, 7.5, 10.0, 12.0, 15.0, 20.0, 30.0, 60.0)  # minutes tried where nobody states them

# Mm per unit of depth, mm/h per unit of rate, by a plain spelling of the unit.
DEPTHS = {"mm": 1.0, "kg/m2": 1.0, "inch": 25.4, "0.01mm": 0.01}
RATES = {"mm/h": 1.0, "m/s": 3.6e6, "kg/m2/s": 3600.0, "inch/h": 25.4}
UNITS = (*RATES, *DEPTHS, "dbz")
TRANSFORMS = ("none", "db", "log", "sqrt")

# Spellings of meta.unit after lower case, without blanks.
_SPELLED = [
    ("dbz", r"dbz"),
    ("kg/m2/s", r"kgm?\^?-2\^?s\^?-1|kgm-2s-1|kgm\^-2s\^-1|kg/m\^?2/s|kg/\(m\^?2s\)"),
    ("kg/m2", r"kgm\^?-2|kg/m\^?2"),
    ("mm/h", r"(mm|millimet(?:re|er)s?)(/|per)(h|hr|hour)|mmh(r)?\^?-1"),
    ("inch/h", r"(in|inch|inches)(/|per)(h|hr|hour)|in(ch)?h(r)?\^?-1"),
    ("m/s", r"m/s|ms\^?-1|met(?:re|er)spersecond"),
    ("0.01mm", r"0\.01mm|1/100mm|mm\*?100\^-1|mm/100|hundredthsofamillimet(?:re|er)"),
    ("inch", r"in|inch|inches"),
    ("mm", r"mm|millimet(?:re|er)s?"),
]
_SPELLED = [(u, re.compile(p)) for u, p in _SPELLED]

# The same in running notes, first match counts.
_NOTED = [
    ("dbz", r"\bdbz\b|reflecti|reflekti"),
    ("kg/m2/s", r"kg ?m\^?-2 ?s\^?-1|kg/m\^?2/s|kg per m\^?2 and s|kilograms? per square met(?:re|er) (?:and|per) second"),
    ("kg/m2", r"kg ?m\^?-2|kg/m\^?2|kg per m\^?2|kilograms? per square met(?:re|er)"),
    ("0.01mm", r"hundredths? of a millimet(?:re|er)|1/100 ?mm|0\.01 ?mm|mm\*100\^-1"),
    ("mm/h", r"mm ?/ ?hr?\b|mm hr?\^?-1|mm pro stunde|mm per hour|millimet(?:re|er)s? per hour|millimeter pro stunde"),
    ("inch/h", r"\bin(?:ch(?:es)?)? ?/ ?hr?\b|inch(?:es)? per hour|\bin hr?\^?-1"),
    ("m/s", r"\bm/s\b|\bm s\^?-1|met(?:re|er)s per second"),
    ("inch", r"\binch(?:es)?\b|\[in\]"),
    ("mm", r"\bmm\b|millimet(?:re|er)"),
]
_NOTED = [(u, re.compile(p, re.I)) for u, p in _NOTED]
_TRANSFORM_NOTE = [
    ("db", re.compile(r"decibel|10 ?\* ?log10|values are db\b|\bin db\b|stored in db\b", re.I)),
    ("log", re.compile(r"\bln ?\(|natural log|natuerlicher log|box-?cox|\bln of\b", re.I)),
    ("sqrt", re.compile(r"square root|sqrt|quadratwurzel", re.I)),
]
_NUMBER = r"([0-9]+(?:\.[0-9]+)?)"
_TIMES = [
    (1.0, re.compile(rf"(?:accutime|accumulation(?: time)?|sum over|accumulated over|total over|over)\s*[=:]?\s*{_NUMBER}\s*min", re.I)),
    (1.0, re.compile(rf"{_NUMBER}[- ]?min(?:ute)?s?[- ](?:total|sum|accumulation)", re.I)),
    (1 / 60, re.compile(rf"(?:accutime|sum over|accumulated over|total over|over)\s*[=:]?\s*{_NUMBER}\s*s(?:ec(?:onds?)?)?\b", re.I)),
    (60.0, re.compile(rf"(?:accutime|sum over|accumulated over|total over|over)\s*[=:]?\s*{_NUMBER}\s*h(?:ours?)?\b", re.I)),
    (60.0, re.compile(rf"{_NUMBER}[- ]?h(?:our)?[- ](?:total|sum|accumulation)", re.I)),
]
_HOUR = re.compile(r"(?:last|one|per full|past) hour|hourly (?:total|sum|accumulation)", re.I)
_RELATION = [
    re.compile(rf"Z\s*=\s*{_NUMBER}\s*\*?\s*R\s*(?:\^|\*\*)\s*{_NUMBER}", re.I),
    re.compile(rf"Z-?R[^;]*?a\s*=\s*{_NUMBER}[^;]*?b\s*=\s*{_NUMBER}", re.I),
]


def stated_unit(unit: str | None, note: str | None) -> str | None:
    """Unit of a frame by its metadata, else by its note; None where neither tells."""
    plain = re.sub(r"[\s\[\]]+", "", (unit or "").lower())
    for name, pattern in _SPELLED:
        if pattern.fullmatch(plain):
            return name
    for name, pattern in _NOTED:
        if note and pattern.search(note):
            return name
    return None


def stated_transform(transform: str | None, note: str | None) -> str | None:
    """Transform by metadata, else by note; None where neither tells."""
    plain = (transform or "").strip().lower()
    found = {"db": "db", "log": "log", "ln": "log", "boxcox": "log", "box-cox": "log", "sqrt": "sqrt"}.get(plain)
    if found:
        return found
    for name, pattern in _TRANSFORM_NOTE:
        if note and pattern.search(note):
            return name
    return "none" if plain == "none" else None


def stated_time(accutime: float | None, note: str | None, usual: float | None) -> float | None:
    """Accumulation time in minutes: metadata, note, then the source's."""
    if accutime and accutime > 0:
        return accutime
    for factor, pattern in _TIMES:
        if note and (m := pattern.search(note)):
            return float(m.group(1)) * factor
    return 60.0 if note and _HOUR.search(note) else usual


def stated_relation(a: float | None, b: float | None, note: str | None) -> tuple[float, float]:
    """a and b of Z = a * R^b: metadata, note, then 200 and 1.6."""
    noted = next((m for p in _RELATION if note and (m := p.search(note))), None)
    return (a or (float(noted.group(1)) if noted else ZR[0]), b or (float(noted.group(2)) if noted else ZR[1]))


def to_rate(value, unit: str, transform: str, minutes, a, b):
    """Stored numbers as mm/h; NaN where the accumulation time is unknown."""
    value = np.asarray(value, float)
    with np.errstate(all="ignore"):
        if unit == "dbz" or transform == "db":
            value = 10.0 ** (value / 10.0)
        elif transform == "log":
            value = np.exp(value)
        elif transform == "sqrt":
            value = value * value
        if unit == "dbz":
            return np.where(value >= 0, (value / np.asarray(a, float)) ** (1.0 / np.asarray(b, float)), np.nan)
        if unit in RATES:
            return value * RATES[unit]
        return value * DEPTHS[unit] * 60.0 / np.asarray(minutes, float)


READINGS = [(u, t) for u in UNITS for t in (("db",) if u == "dbz" else TRANSFORMS)]


def _numbers(rows: dict[str, pa.Array]) -> dict[str, np.ndarray]:
    return {c: rows[c].to_numpy(zero_copy_only=False).astype(float) for c in rows}


def _dry_gap(threshold, zero, transform: str):
    """Distance of the dry value from the threshold in dB or log, else the dry value itself."""
    return threshold - zero if transform in ("db", "log") else zero


def best_readings(unit: list, transform: list, facts: dict[str, np.ndarray], reference: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The reading of least total for each frame.

    unit, transform: what is stated, None where nothing is. facts: threshold,
    zero, peak, minutes, a and b, NaN where unknown. reference: floor, level and
    spread (log10 mm/h) and gap_<transform> of each frame's source, NaN where no
    frame tells. Returns unit, transform, minutes, misfit, unique and peak.
    """
    n = len(unit)
    f = {k: np.asarray(v, float) for k, v in facts.items()}
    said_unit = np.array([UNITS.index(u) if u else -1 for u in unit])
    said_transform = np.array([TRANSFORMS.index(t) if t else -1 for t in transform])
    timeless = ~(f["minutes"] > 0)
    tried = [(u, t, None) for u, t in READINGS]
    if timeless.any():
        tried += [(u, t, m) for u, t in READINGS if u in DEPTHS for m in TIMES]
    total, sure, misfit, peaks = (np.full((n, len(tried)), np.inf) for _ in range(4))
    with np.errstate(all="ignore"):
        for j, (u, t, m) in enumerate(tried):
            minutes = f["minutes"] if m is None else np.full(n, m)
            floor = to_rate(f["threshold"], u, t, minutes, f["a"], f["b"])
            known = np.isfinite(f["threshold"])
            off = np.abs(np.log10(floor) - reference["floor"])
            off = np.where(known, np.where(floor > 0, np.where(np.isnan(reference["floor"]), 0.0, off), 9.0), 0.0)
            gap = np.abs(_dry_gap(f["threshold"], f["zero"], t) - reference[f"gap_{t}"])
            off = off + np.where(known & np.isfinite(gap), np.minimum(1.0, gap), 0.0)
            peak = to_rate(f["peak"], u, t, minutes, f["a"], f["b"])
            z = (np.log10(peak) - reference["level"]) / reference["spread"]
            cost = np.where((said_unit >= 0) & (said_unit != UNITS.index(u)), CONTRADICTION, 0.0)
            silent = np.where((said_unit >= 0) & (t != "none") & (u != "dbz"), SILENCE, 0.0)
            spoken = np.where(TRANSFORMS.index(t) != said_transform, 0.0 if u == "dbz" else CONTRADICTION, 0.0)
            cost = cost + np.where(said_transform >= 0, spoken, silent)
            if m is not None:  # a time of one's own counts only where the floor confirms it
                cost = np.where(timeless & known & ~np.isnan(reference["floor"]) & (off <= CLOSE), cost, np.inf)
            elif u in DEPTHS:  # without a time a depth is only what is left where no time fits
                cost = cost + np.where(timeless, 26 * LEVEL, 0.0)
                off = np.where(timeless, 0.0, off)
            misfit[:, j], peaks[:, j], sure[:, j] = off, peak, off + cost
            total[:, j] = off + cost + LEVEL * np.where(np.isfinite(z), np.minimum(z * z, 25.0), 0.0)
    best, at = np.argmin(total, 1), np.arange(n)
    own_sure = sure[at, best]
    sure[at, best] = np.inf  # a tie that only the usual level decides is still a tie
    chosen_unit = np.array([UNITS.index(tried[j][0]) for j in best], int).reshape(n)
    kept = (said_unit < 0) | (chosen_unit == said_unit)
    own = np.array([tried[j][2] or np.nan for j in best], float).reshape(n)
    minutes = np.where(np.isnan(own), f["minutes"], own)
    unknown = timeless & np.isnan(own) & np.array([tried[j][0] in DEPTHS for j in best], bool).reshape(n)
    lone = (sure.min(1) - own_sure > CLOSE) & (misfit[at, best] <= TOLERANCE) & kept & ~unknown
    return {
        "unit": np.array([tried[j][0] for j in best], object),
        "transform": np.array([tried[j][1] for j in best], object),
        "minutes": minutes,
        "misfit": misfit[at, best],
        "unique": lone,
        "peak": np.where(unknown, np.nan, peaks[at, best]),
    }


def _stated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What metadata and notes state, and the frame's floor and level where that leaves one reading."""
    kinds = dict(unit=pa.string(), transform=pa.string(), minutes=pa.float64(), a=pa.float64(), b=pa.float64(), floor=pa.float64(), level=pa.float64(), gap=pa.float64())
    for batch in batches:
        r = {c: batch.column(c).to_pylist() for c in ("unit", "transform", "note", "accutime", "usual", "zr_a", "zr_b", "threshold", "zerovalue", "peak")}
        out: list[list] = [[] for _ in kinds]
        for unit, transform, note, accutime, usual, za, zb, threshold, zero, peak in zip(*r.values()):
            u, t, m = stated_unit(unit, note), stated_transform(transform, note), stated_time(accutime, note, usual)
            a, b = stated_relation(za, zb, note)
            floor = level = gap = None
            if u and (u == "dbz" or t) and (m or u not in DEPTHS) and threshold is not None:
                t_ = "db" if u == "dbz" else t
                rate = float(to_rate(threshold, u, t_, m or math.nan, a, b))
                floor = math.log10(rate) if 0 < rate < math.inf else None
                gap = None if zero is None else float(_dry_gap(threshold, zero, t_))
                if peak is not None and peak > threshold:
                    rate = float(to_rate(peak, u, t_, m or math.nan, a, b))
                    level = math.log10(rate) if 0 < rate < math.inf else None
            for col, v in zip(out, (u, t, m, a, b, floor, level, gap)):
                col.append(v)
        keep = ("frame_id", "source", "threshold", "zerovalue", "peak")
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *[pa.array(c, k) for c, k in zip(out, kinds.values())]], names=[*keep, *kinds])


def references(stated: DataFrame, sources: DataFrame) -> DataFrame:
    """``(source, floor, level, spread, gap_<transform>...)`` of every source that has frames.

    Medians over the frames whose statements leave one reading; a source without
    any takes those of its institution's sources, else those of all.
    """
    median = lambda c: F.percentile_approx(c, 0.5, 1000)
    kin = require(sources, "source", "institution").dropDuplicates(["source"])
    s = stated.join(kin, "source", "left")
    of = F.when(F.col("unit") == "dbz", "db").otherwise(F.col("transform"))
    measures = [median("floor").alias("floor"), median("level").alias("level"), (F.percentile_approx("level", 0.84, 1000) - median("level")).alias("spread")]
    measures += [median(F.when(of == t, F.col("gap"))).alias(f"gap_{t}") for t in TRANSFORMS]
    names = ["floor", "level", "spread", *[f"gap_{t}" for t in TRANSFORMS]]
    own = s.groupBy("source", "institution").agg(*measures)
    peers = s.groupBy("institution").agg(*measures).select(F.col("institution").alias("_i"), *[F.col(c).alias(f"_{c}") for c in names])
    every = s.agg(*measures)
    joined = own.join(peers, own["institution"].eqNullSafe(F.col("_i")), "left")
    known = {c: F.coalesce(c, f"_{c}", every.select(c).scalar()) for c in names}
    known["spread"] = F.greatest(F.lit(LEAST_SPREAD), known["spread"])
    return joined.select("source", *[v.alias(c) for c, v in known.items()])


_RESULT = "frame_id bigint, source string, unit string, transform string, unit_stated boolean, minutes double, zr_a double, zr_b double, misfit double, unique boolean, peak double, above boolean"


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _RESULT.split(", ")]
    for batch in batches:
        unit = batch.column("unit").to_pylist()
        f = _numbers({"threshold": batch.column("threshold"), "zero": batch.column("zerovalue"), **{c: batch.column(c) for c in ("peak", "minutes", "a", "b")}})
        reference = _numbers({c: batch.column(c) for c in ("floor", "level", "spread", *[f"gap_{t}" for t in TRANSFORMS])})
        got = best_readings(unit, batch.column("transform").to_pylist(), f, reference)
        with np.errstate(invalid="ignore"):
            above = ~np.isnan(f["peak"]) & (np.isnan(f["threshold"]) | (f["peak"] > f["threshold"]))
        nullable = lambda v: pa.array(v, mask=np.isnan(v))
        cols = [
            batch.column("frame_id"), batch.column("source"), pa.array(got["unit"], pa.string()), pa.array(got["transform"], pa.string()), pa.array([u is not None for u in unit], pa.bool_()),
            nullable(got["minutes"]), batch.column("a"), batch.column("b"), pa.array(got["misfit"]), pa.array(got["unique"]), nullable(got["peak"]), pa.array(above),
        ]
        yield pa.RecordBatch.from_arrays(cols, names=names)


def resolve_units(frames: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per frame: the unit, transform, time and relation its numbers are in.

    ``peak`` is the largest valid pixel in mm/h (null: none, or unknown time),
    ``above`` whether it passes the frame's threshold, ``unit_stated`` whether
    metadata or note names a unit, ``misfit`` the log units by which the frame's
    threshold and dry value miss those of its source, ``unique`` whether the
    reading is alone (see the module). Null, NaN and infinite pixels aren't
    valid; a null meta or data gives a row without peak; a frame stored twice
    counts once. Pixels stay in the JVM, only their maximum goes to Python, in
    vectors of frames.
    """
    usual = require(sources, "source", "accutime").dropDuplicates(["source"]).withColumnRenamed("accutime", "usual")
    valid = F.filter("data", lambda p: p.isNotNull() & ~F.isnan(p) & (F.abs(p) < float("inf")))
    finite = lambda c: F.when(F.abs(c) < float("inf"), c)
    rows = require(frames, "frame_id", "source", "data", "meta", "note").select(
        "frame_id", "source", F.array_max(valid).alias("peak"), "note", *[F.col(f"meta.{c}").alias(c) for c in ("unit", "transform", "accutime")], *[finite(F.col(f"meta.{c}")).alias(c) for c in ("threshold", "zerovalue", "zr_a", "zr_b")]
    )
    rows = rows.dropDuplicates(["frame_id"]).join(usual, "source", "left")
    kept = "frame_id bigint, source string, threshold double, zerovalue double, peak double, unit string, transform string, minutes double, a double, b double, floor double, level double, gap double"
    stated = written(rows.mapInArrow(_stated, kept), "stated")
    known = references(stated, sources).withColumnRenamed("source", "_source")
    rows = stated.drop("floor", "level", "gap").join(known, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    return rows.mapInArrow(_resolve, _RESULT)


def to_rain_rate(frames: DataFrame, sources: DataFrame) -> DataFrame:
    """``(frame_id, source, ny, nx, rate, unique)``: all pixels of every frame in mm/h.

    Missing pixels are null, dry ones (not above the threshold) 0. Frames whose
    unit nobody states are brought over by the best combination and not marked
    unique unless it stands alone.
    """
    how = resolve_units(frames, sources).select("frame_id", "unit", "transform", "minutes", F.col("zr_a").alias("a"), F.col("zr_b").alias("b"), "unique")
    f = require(frames, "frame_id", "source", "ny", "nx", "data", "meta").dropDuplicates(["frame_id"]).join(how, "frame_id")
    factor = F.coalesce(*[F.when(F.col("unit") == u, F.lit(k)) for u, k in RATES.items()], *[F.when(F.col("unit") == u, F.lit(k) * 60.0 / F.col("minutes")) for u, k in DEPTHS.items()])

    def rate(p):
        plain = F.when(F.col("transform") == "db", F.pow(F.lit(10.0), p / 10.0)).when(F.col("transform") == "log", F.exp(p)).when(F.col("transform") == "sqrt", p * p).otherwise(p)
        wet = F.when(F.col("unit") == "dbz", F.pow(plain / F.col("a"), 1.0 / F.col("b"))).otherwise(plain * factor)
        return F.when(p.isNull() | F.isnan(p), F.lit(None)).when(p <= F.col("meta.threshold"), F.lit(0.0)).otherwise(wet)

    return f.select("frame_id", "source", "ny", "nx", F.transform("data", rate).alias("rate"), "unique")
