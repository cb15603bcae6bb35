"""Percentiles of very large columns, per group, by distributed multi-select.

Values are first counted per group: these counts are the partial results, which
add up over partitions and days. Every partition then proposes medians of equal
slices of its candidates, the weighted medians of the proposals become pivots,
values below, at and above each pivot are counted, ranges that hold no wanted
rank are discarded from the candidates, and this repeats per group until each
range is small enough to be ranked by one task (or, with an error bound, holds
no more ranks than the bound allows).

Where even the counts are too many to keep, ``summaries`` reduces a part of the
table to a bounded number of weighted values per group; summaries of several
parts are combined by ``merge_counts`` and the errors add up in proportion to
the parts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rainweft.workspace import dropped, require, written

PER_MILLE = (10, 50, 250, 500, 750, 900, 950, 990, 999)
FEW = 1024  # different values of a range that one task may rank
PIVOTS = 31  # of a range and round


def value_counts(rows: DataFrame, groups: Sequence[str], value: str, key: str | None = None) -> DataFrame:
    """``(groups..., v, c)``: how often each finite value occurs in a group.

    With ``key``, rows stored twice (equal in key, groups and value) count once.
    Results of different parts of a table (disjoint in ``key``) are combined by
    ``merge_counts``. Null, NaN and infinite values are left out; null group keys
    form a group; an empty table gives no rows; other columns are not read.
    """
    rows = require(rows, *groups, value, *([key] if key and key not in groups else []))
    v = F.col(value).cast("double")
    rows = rows.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = rows.select(*groups, (v + F.lit(0.0)).alias("v"), *([key] if key and key not in groups else []))
    if key:
        rows = rows.distinct()  # over all columns: hashed, where duplicates by key alone would be sorted
    return rows.groupBy(*groups, "v").agg(F.count("*").alias("c"))


def merge_counts(counts: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Partial results added up, over days or from unions; ``groups`` are those to keep."""
    return counts.groupBy(*groups, "v").agg(F.sum("c").alias("c"))


def _propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each range in a batch, the medians of PIVOTS slices of equal weight and their weight."""
    for batch in batches:
        if not batch.num_rows:
            continue
        gid, part, v, c = (batch.column(n).to_numpy() for n in ("gid", "part", "v", "c"))
        order = np.lexsort((v, part, gid))
        gid, part, v, c = gid[order], part[order], v[order], c[order]
        first = np.ones(len(v), bool)
        first[1:] = (gid[1:] != gid[:-1]) | (part[1:] != part[:-1])
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(v))
        run = np.cumsum(c)
        base = run[starts] - c[starts]
        weight = run[ends - 1] - base
        slices = np.minimum(ends - starts, PIVOTS)
        which = np.repeat(np.arange(len(starts)), slices)
        no = np.arange(len(which)) - np.repeat(np.cumsum(slices) - slices, slices)
        middle = base[which] + np.maximum(1, (2 * no + 1) * weight[which] // (2 * slices[which]))
        at = np.searchsorted(run, middle)
        share = np.maximum(1, weight[which] // slices[which])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (gid[starts][which], part[starts][which], v[at], share)], names=["gid", "part", "p", "w"])


def _rank(n, k):
    """ceil(n * k / 1000), at least 1."""
    return F.greatest(F.lit(1), F.ceil(F.round(n * k, 3) / 1000)).cast("bigint")


def percentiles(counts: DataFrame, groups: Sequence[str], per_mille: Sequence[float] = PER_MILLE, few: int = FEW, rank_error: float = 0.0) -> DataFrame:
    """``(groups..., n, per_mille, value, rank_error)`` from value counts.

    value is the smallest one whose rank is at least ``ceil(n * per_mille / 1000)``
    (1 at least); the reported ``rank_error`` bounds the distance of its rank from
    that as a share of n. At ``rank_error`` 0 the result is exact; above, a range
    that holds at most that share of the ranks is no longer narrowed and its
    largest value is returned, while a range that one task can rank is ranked
    exactly whatever its weight. Groups without values don't appear; null group
    keys form a group; ties count with their number.
    """
    g = [F.col(c) for c in groups]
    work = counts.select(F.xxhash64(*g, *[x.isNull() for x in g]).alias("gid"), F.lit(0).cast("bigint").alias("part"), *groups, "v", "c")
    sizes = written(work.groupBy("gid", *groups).agg(F.sum("c").alias("n"), F.count("*").alias("m")), "sizes").withColumn("g", F.struct(*groups) if groups else F.struct(F.lit(0)))
    group_type = sizes.schema["g"].dataType.simpleString()
    ks = F.array(*[F.lit(float(k)) for k in per_mille])
    # a range: its wanted ranks, the weight before it, its number of values and their weight
    wanted = F.transform(ks, lambda k: F.struct(k.alias("k"), _rank(F.col("n"), k).alias("rank")))
    state = sizes.select("gid", F.lit(0).cast("bigint").alias("part"), "g", "n", wanted.alias("wanted"), F.lit(0).cast("bigint").alias("below"), "m", F.col("n").alias("weight"))
    work, done = work.select("gid", "part", "v", "c"), None
    while True:  # every round discards a value of each range at least, and all but a few slices as a rule
        wide = (F.col("m") > few) & (F.col("weight") > F.col("n") * rank_error)
        ended = _ranked(work, state, few, rank_error, group_type)
        done = ended if done is None else done.unionAll(ended)
        open_ = state.where(wide)
        if open_.isEmpty():
            break
        mine = written(work.join(open_.select("gid", "part"), ["gid", "part"], "left_semi"), "candidates")
        proposed = mine.mapInArrow(_propose, "gid bigint, part bigint, p double, w bigint")
        cuts = [(i + 1) / (PIVOTS + 1) for i in range(PIVOTS)]
        # the weighted medians of the slices' medians; a pivot need not be a value itself
        pivots = written(proposed.groupBy("gid", "part").agg(F.array_distinct(F.percentile("p", cuts, F.col("w"))).alias("pivots")), "pivots")
        # below, at and above each pivot: an odd bucket is at one
        placed = mine.join(pivots, ["gid", "part"]).withColumn("less", F.size(F.filter("pivots", lambda p: p < F.col("v"))))
        at = F.coalesce(F.get(F.col("pivots"), F.col("less")) == F.col("v"), F.lit(False)).cast("int")
        counted = placed.groupBy("gid", "part", (2 * F.col("less") + at).alias("bucket")).agg(F.sum("c").alias("weight"), F.count("*").alias("m"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        counted = counted.groupBy("gid", "part").agg(F.array_sort(F.collect_list(F.struct("bucket", "weight", "m", "lo", "hi"))).alias("buckets"))
        ranges = open_.select("gid", "part", "g", "n", "wanted", "below").join(counted, ["gid", "part"])
        before = F.expr("aggregate(slice(buckets, 1, no), below, (a, b) -> a + b.weight)")
        ranges = ranges.select("*", F.posexplode("buckets").alias("no", "b")).withColumn("before", before)
        inside = F.filter("wanted", lambda x: (x["rank"] > F.col("before")) & (x["rank"] <= F.col("before") + F.col("b.weight")))
        ranges = ranges.select("gid", F.col("part").alias("old"), F.xxhash64("part", "b.bucket").alias("part"), "g", "n", inside.alias("wanted"), F.col("before").alias("below"), "b.m", "b.weight", "b.lo", "b.hi")
        state = written(ranges.where("size(wanted) > 0"), "ranges")
        # only rows of ranges that hold a wanted rank go on
        kept = mine.withColumnRenamed("part", "old").join(state.select("gid", "old", "part", "lo", "hi"), ["gid", "old"]).where("v between lo and hi")
        work = written(kept.select("gid", "part", "v", "c"), "kept")
        dropped(mine)
        dropped(pivots)
        state = state.select("gid", "part", "g", "n", "wanted", "below", "m", "weight")
    kind = "int" if all(float(k).is_integer() for k in per_mille) else "double"
    return done.select(*[F.col("g")[c].alias(c) for c in groups], "n", F.col("k").cast(kind).alias("per_mille"), "value", F.col("err").alias("rank_error"))


def _rank_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Values at the wanted ranks of ranges whose cells are in the row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        cells, wanted = batch.column("cells"), batch.column("wanted")
        size, asked = (np.diff(x.offsets.to_numpy()) for x in (cells, wanted))
        row = np.repeat(np.arange(batch.num_rows), size)
        v, c = (cells.flatten().field(k).to_numpy() for k in (0, 1))
        order = np.lexsort((v, row))
        v, run = v[order], np.cumsum(c[order])
        ends = np.cumsum(size)
        base = np.concatenate([[0], run[ends[:-1] - 1]])
        k, rank = (wanted.flatten().field(i).to_numpy() for i in (0, 1))
        of = np.repeat(np.arange(batch.num_rows), asked)
        at = np.searchsorted(run, base[of] + rank - batch.column("below").to_numpy()[of])
        g, n = (batch.column(x).take(pa.array(of)) for x in ("g", "n"))
        yield pa.RecordBatch.from_arrays([g, n, pa.array(k), pa.array(v[at]), pa.array(np.zeros(len(of)))], names=["g", "n", "k", "value", "err"])


def _ranked(work: DataFrame, state: DataFrame, few: int, rank_error: float, group_type: str) -> DataFrame:
    """``(g, n, k, value, err)`` of ranges that are no longer narrowed.

    A range of few values is ranked from its values; of one whose weight is
    within the bound only the largest value is needed. The states of all groups
    are joined by a shuffle, since their number grows with the groups; ranges of
    more values than ``few`` are few.
    """
    on = ["gid", "part"]
    large = F.col("m") > few
    cells = work.join(state.where(large).select(*on), on, "left_anti").groupBy(*on).agg(F.collect_list(F.struct("v", "c")).alias("cells"))
    small = state.where(~large).select(*on, "g", "n", "wanted", "below").hint("shuffle_hash")
    out = cells.join(small, on).mapInArrow(_rank_cells, f"g {group_type}, n bigint, k double, value double, err double")
    if rank_error:
        rest = state.where(large & (F.col("weight") <= F.col("n") * rank_error))
        top = work.join(rest.select(*on), on, "left_semi").groupBy(*on).agg(F.max("v").alias("value"))
        out = out.unionAll(rest.join(top, on).select("g", "n", F.explode("wanted.k").alias("k"), "value", (F.col("weight") / F.col("n")).alias("err")))
    return out


def summaries(counts: DataFrame, groups: Sequence[str], parts: int = 1000, few: int = FEW) -> DataFrame:
    """``(groups..., v, c)``: at most ``parts`` weighted values of each group.

    The values at ranks n/parts, 2n/parts, ... stand for the ranks since the one
    before, so any rank found from a summary is off by less than a share of
    1/parts of n. Summaries of several parts of a table (days, partitions) are
    combined by ``merge_counts``: the error in rank stays below 1/parts of all
    rows.
    """
    per_mille = [1000.0 * (k + 1) / parts for k in range(parts)]
    at = percentiles(counts, groups, per_mille, few)
    rank = _rank(F.col("n"), F.col("per_mille"))
    g = [F.col(c) for c in groups]
    at = at.select(*groups, F.xxhash64(*g, *[x.isNull() for x in g]).alias("gid"), F.col("value").alias("v"), rank.alias("rank"))
    ends = at.groupBy("gid", *groups, "v").agg(F.max("rank").alias("upto"))
    # values in order, their ranks differenced: at most ``parts`` entries a group
    listed = ends.groupBy("gid", *groups).agg(F.array_sort(F.collect_list(F.struct("v", "upto"))).alias("e"))
    return listed.select(*groups, F.posexplode("e").alias("i", "x"), "e").select(*groups, "x.v", (F.col("x.upto") - F.coalesce(F.get(F.col("e"), F.col("i") - 1)["upto"], F.lit(0))).alias("c")).where("c > 0")
