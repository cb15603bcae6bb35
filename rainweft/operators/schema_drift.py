"""File headers whose fields drift, read into one table with a log of changes.

The leaves of every header form a catalogue of column lifespans: an alias table
names the attribute behind a path, and consecutive files of a feed in which an
attribute has one path and type are an island. Islands are formed in one ordered
pass over blocks of a feed and day, so that a feed with a third of all files
isn't held by one task; the few islands are then numbered, lagged and joined
over the blocks' edges. Their starts and endings are the changes. The same
catalogue generates the casts of the table.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from rainweft.workspace import require, written

# Spellings of an attribute, without case and underscores, by the last name of the path.
ALIASES = {
    "gain": ("gain", "scalefactor", "gainfactor", "slope", "scale", "multiplier"),
    "offset": ("offset", "addoffset", "bias", "intercept"),
    "nodata": ("nodata", "fillvalue", "missing", "missingvalue", "nodatavalue"),
    "undetect": ("undetect", "undetected", "belowdetection", "zeroflag", "undetectvalue"),
    "quantity": ("quantity", "qty", "product"),
    "startepoch": ("startepoch", "starttime", "validfrom"),
}
_ATTRIBUTE = {name: attribute for attribute, names in ALIASES.items() for name in names}

# Types of the columns that every table has; further attributes are typed by the catalogue.
CASTS = {
    "gain": "double",
    "offset": "double",
    "nodata": "double",
    "undetect": "double",
    "quality_gain": "double",
    "mfb": "double",
    "beamwidth": "double",
    "wavelength": "double",
    "nscans": "double",
    "zr_a": "double",
    "zr_b": "double",
    "quantity": "string",
    "software": "string",
    "task": "string",
    "startepoch": "bigint",
    "simulated": "boolean",
}
MOST_COLUMNS = 1000  # further attributes with a column of their own; those beyond stay in ``more``


def attribute(path: str) -> str:
    """The attribute that a path of a leaf stands for: alias of its last name, else that name."""
    last = path.rsplit(".", 1)[-1]
    return _ATTRIBUTE.get(re.sub("_", "", last.lower()), last.lower())


def _leaves(found: dict, path: str, into: dict) -> None:
    for name, value in found.items():
        here = f"{path}.{name}" if path else name
        if isinstance(value, dict):
            _leaves(value, here, into)
        else:
            into[here] = value


def _kind(value) -> str | None:
    if value is None:
        return None
    if isinstance(value, bool):
        return "boolean"
    return "string" if isinstance(value, str) else "array" if isinstance(value, list) else "number"


def _read(text: str | None) -> list[tuple[str, str, str | None, object]] | None:
    """``(attribute, path, kind, value)`` of the leaves of a header; None where it can't be read.

    Of two leaves of one attribute the deeper (then the one that sorts later)
    keeps its own path as name.
    """
    try:
        found = json.loads(text)
    except (TypeError, ValueError, RecursionError):
        return None
    if not isinstance(found, dict):
        return None
    flat: dict = {}
    _leaves(found, "", flat)
    out: dict[str, tuple] = {}
    for path in sorted(flat, key=lambda p: (p.count("."), attribute(p) != p, p)):
        name = attribute(path)
        name = path if name in out else name
        out[name] = (name, path, _kind(flat[path]), flat[path])
    return list(out.values())


def _islands(batches: Iterator[pa.RecordBatch], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Islands of the ordered files of each block, and one row without attribute for the block itself."""
    cols: list[list] = [[] for _ in _ISLAND]
    where: tuple | None = None
    no, file, last_row = -1, None, None
    open_: dict[str, list] = {}
    kinds: dict[str, str] = {}
    first = None

    def put(name, path, kind, first_no, last_no, first_file, last_file, next_file):
        for col, v in zip(cols, (*where, name, path, kind, first_no, last_no, first_file, last_file, next_file)):
            col.append(v)

    def close():
        if no >= 0:
            for name, (path, kind, a, b, fa, fb) in open_.items():
                put(name, path, kind, a, b, fa, fb, None)
            put(None, None, None, 0, no, first, file, None)

    for batch in batches:
        rows = zip(*[batch.column(c).to_pylist() for c in ("feed_id", "block", "ts", "file_id", "header_json")])
        for feed, block, ts, file_id, text in rows:
            if where != (feed, block):
                close()
                where, no, open_, kinds, last_row = (feed, block), -1, {}, {}, None
            row = (ts, file_id, None if file_id is not None else text)
            if row == last_row:
                continue
            last_row = row
            leaves = _read(text)
            if leaves is None:
                continue
            no, file = no + 1, file_id
            if no == 0:
                first = file_id
            for name, path, kind, _ in leaves:
                kind = kinds[name] = kind or kinds.get(name)  # a null keeps the type last seen
                held = open_.get(name)
                if held and held[0] == path and held[1] == kind:
                    held[3], held[5] = no, file_id
                else:
                    if held:
                        put(name, *held, file_id)
                    open_[name] = [path, kind, no, no, file_id, file_id]
            for name in [k for k, held in open_.items() if held[3] < no]:
                put(name, *open_.pop(name), file_id)
        if len(cols[0]) >= 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=_ISLAND)
            cols = [[] for _ in _ISLAND]
    close()
    if cols[0]:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=_ISLAND)


_ISLAND = ["feed_id", "block", "attribute", "path", "kind", "first_no", "last_no", "first_file", "last_file", "next_file"]


def islands(headers: DataFrame) -> DataFrame:
    """Islands of all feeds, lagged: ``(feed_id, attribute, path, kind, first_no, last_no, first_file, last_file, next_file, prev_*, next_no)``.

    Numbers count the readable files of a feed from 1 by ts, then file_id; files
    without ts come first, those without feed form a feed of their own. Islands
    that meet at the edge of two blocks are still two rows. One shuffle of the
    headers; what follows handles a few rows per feed, day and attribute.
    """
    rows = require(headers, "file_id", "feed_id", "ts", "header_json").select("feed_id", F.to_date("ts").alias("block"), "ts", "file_id", "header_json")
    rows = rows.repartition("feed_id", "block").sortWithinPartitions("feed_id", "block", "ts", "file_id")
    of = {f.name: f.dataType for f in rows.schema}
    feed, file = of["feed_id"].simpleString(), of["file_id"].simpleString()
    types = [to_arrow_type(of["feed_id"]), pa.date32(), *[pa.string()] * 3, pa.int64(), pa.int64(), *[to_arrow_type(of["file_id"])] * 3]
    found = rows.mapInArrow(
        lambda batches: _islands(batches, types),
        f"feed_id {feed}, block date, attribute string, path string, kind string, first_no bigint, last_no bigint, first_file {file}, last_file {file}, next_file {file}",
    )
    found = written(found, "islands")
    in_feed = Window.partitionBy("feed_id").orderBy("block")
    earlier = F.coalesce(F.sum(F.col("last_no") + 1).over(in_feed.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = found.where("attribute is null").select(F.col("feed_id").alias("_feed"), F.col("block").alias("_block"), (earlier + 1).alias("_base"), F.lead("first_file").over(in_feed).alias("_next"))
    one = found.where("attribute is not null").join(blocks, F.col("feed_id").eqNullSafe(F.col("_feed")) & F.col("block").eqNullSafe(F.col("_block")))
    one = one.select(
        "feed_id", "attribute", "path", "kind", (F.col("first_no") + F.col("_base")).alias("first_no"), (F.col("last_no") + F.col("_base")).alias("last_no"), "first_file", "last_file", F.coalesce("next_file", "_next").alias("next_file")
    )
    w = Window.partitionBy("feed_id", "attribute").orderBy("first_no")
    one = one.withColumn("kind", F.last("kind", True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return one.select("*", *[F.lag(c).over(w).alias(f"prev_{c}") for c in ("path", "kind", "last_no")], F.lead("first_no").over(w).alias("next_no"))


_KEPT = "coalesce(prev_last_no = first_no - 1, false)"


def changes(headers: DataFrame) -> DataFrame:
    """``(file_id, field_path, change_kind)``: every change inside each feed.

    Each readable file is compared with the one before it by ts (then file_id);
    the first of a feed has no changes. Files without ts come first in their
    feed; files without feed form one. Rows equal in feed, ts and file_id count
    once. See TESTDATA.md for the four kinds.
    """
    gone = "next_file is not null and coalesce(next_no > last_no + 1, true)"
    kinds = [
        ("added", f"first_no > 1 and not {_KEPT}", "first_file"),
        ("renamed", f"{_KEPT} and path <> prev_path", "first_file"),
        ("retyped", f"{_KEPT} and kind <> prev_kind", "first_file"),
        ("removed", gone, "next_file"),
    ]
    each = F.array(*[F.when(F.expr(rule), F.struct(F.col(file).alias("file_id"), F.lit(kind).alias("change_kind"))) for kind, rule, file in kinds])
    found = islands(headers).select("path", F.explode(F.filter(each, lambda c: c.isNotNull())).alias("c"))
    return found.select("c.file_id", F.col("path").alias("field_path"), "c.change_kind")


def lifespans(headers: DataFrame) -> DataFrame:
    """``(feed_id, attribute, field_path, kind, first_no, first_file, last_file, n_files)``: the catalogue.

    A row for each stretch of consecutive readable files of a feed in which the
    attribute has one path and type; kind is null where only nulls were seen.
    """
    new = F.expr(f"not ({_KEPT} and path = prev_path and coalesce(kind = prev_kind, prev_kind is null))")
    w = Window.partitionBy("feed_id", "attribute").orderBy("first_no")
    spans = islands(headers).withColumn("span", F.sum(new.cast("int")).over(w))
    spans = spans.groupBy("feed_id", "attribute", "span").agg(
        F.first("path").alias("field_path"), F.max("kind").alias("kind"), F.min("first_no").alias("first_no"), F.min_by("first_file", "first_no").alias("first_file"), F.max_by("last_file", "last_no").alias("last_file"), F.sum(F.expr("last_no - first_no + 1")).alias("n_files")
    )
    return spans.drop("span")


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("attribute", pa.string()), ("kind", pa.string()), ("value", pa.string())]))
    for batch in batches:
        ok, leaves = [], []
        for text in batch.column("header_json").to_pylist():
            found = _read(text)
            out = []
            for name, _, sort, value in found or ():
                first = value[0] if isinstance(value, list) and len(value) == 1 else value
                plain = None if first is None else first if isinstance(first, str) else json.dumps(first)
                out.append({"attribute": name, "kind": (_kind(first) if first is not value else sort), "value": plain})
            ok.append(found is not None)
            leaves.append(out)
        names = [c for c in batch.schema.names if c != "header_json"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(ok), pa.array(leaves, kind)], names=[*names, "readable", "leaves"])


def _cast(name: str, kind: str):
    text = f"_v[{_quoted(name)}]"
    if kind == "double":
        return f"try_cast(replace({text}, ',', '.') as double)"
    if kind == "bigint":
        return f"try_cast(try_cast(replace({text}, ',', '.') as double) as bigint)"
    return f"try_cast({text} as {kind})"


def _quoted(name: str) -> str:
    return "'" + name.replace("\\", "\\\\").replace("'", "\\'") + "'"


def consistent_table(headers: DataFrame) -> DataFrame:
    """One row per file with the same typed columns for all, read through the alias table.

    Columns are those of CASTS and, in order of name, every further attribute of
    the files, as double or boolean where it is never anything else and as string
    otherwise. Numbers in strings (with decimal point or comma) and in arrays of
    one are cast. ``more`` is a JSON object of the values that their column can't
    hold, so nothing is lost; it is null where there are none. Unreadable headers
    (``readable`` false) give a row without values; rows stored twice count once.
    """
    rows = require(headers, "file_id", "feed_id", "ts", "header_json").dropDuplicates(["file_id"])
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    rows = written(rows.mapInArrow(_parse, f"file_id {kinds['file_id']}, feed_id {kinds['feed_id']}, ts {kinds['ts']}, readable boolean, leaves array<struct<attribute:string,kind:string,value:string>>"), "leaves")
    leaf = rows.select(F.explode("leaves").alias("l")).select("l.*").where(~F.col("attribute").isin(list(CASTS)))
    further = leaf.groupBy("attribute").agg(F.array_sort(F.collect_set("kind")).alias("kinds")).orderBy("attribute").limit(MOST_COLUMNS).collect()
    plan = dict(CASTS) | {r["attribute"]: {("number",): "double", ("boolean",): "boolean"}.get(tuple(r["kinds"]), "string") for r in further if r["attribute"] not in ("file_id", "feed_id", "ts", "readable", "more")}
    table = rows.withColumn("_v", F.map_from_entries(F.transform("leaves", lambda l: F.struct(l["attribute"], l["value"]))))
    cols = [F.expr(_cast(name, kind)).alias(name) for name, kind in plan.items()]
    held = F.expr("filter(map_entries(_v), e -> e.value is not null and (false" + "".join(f" or (e.key = {_quoted(n)} and {_cast(n, k)} is null)" for n, k in plan.items()) + f" or not array_contains(array({', '.join(map(_quoted, plan))}), e.key)))")
    return table.select("file_id", "feed_id", "ts", "readable", *cols, F.when(F.size(held) > 0, F.to_json(F.map_from_entries(held))).alias("more"))
