"""Irregular readings brought onto the regular slots of their run.

Slots without a reading are filled by iterative singular-spectrum imputation:
the bucketed series is embedded in a Hankel matrix, its leading singular
vectors rebuild it, the missing entries take the rebuilt values, and this
repeats until they no longer move. Filled slots are marked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rainweft.workspace import require

BLOCK = 1024  # slots imputed together
SPREAD = 4096  # slots of a run made by one row
EDGE = 24  # slots that a block sees of each neighbour; a last block shorter than that joins the one before
ROUNDS, TOLERANCE, RELAX = 100, 1e-3, 1.6
EMBEDDINGS = ((4, 2), (12, 3), (24, 3))  # width and singular vectors kept; the width is half the series at most
CLEARLY = 0.5  # of the first embedding's squared error another must stay below, as few readings tell little
ASKED, TRIED = 5, 6  # each fifth reading is held out, in rounds enough to tell the embeddings apart


def _start(values: np.ndarray, outside: dict[int, float]) -> np.ndarray | None:
    """The series with its gaps filled by straight lines; None where nothing is known."""
    known = np.flatnonzero(~np.isnan(values))
    places = dict(zip(known.tolist(), values[known].tolist())) | outside
    if not places:
        return None
    at = sorted(places)
    return np.interp(np.arange(len(values)), at, [places[k] for k in at])


def impute_stack(stack: np.ndarray, outside: list[dict[int, float]] | None = None, embeddings=EMBEDDINGS, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """Series of one length with their NaN entries filled, and whether each has converged.

    A short embedding follows rough series, a long one the waves of smooth ones:
    each series takes the short one unless another gives its own held-out readings clearly better. All
    series of a stack go through the rounds together, and each leaves them once
    its filled entries move by less than ``tolerance`` of its spread. Series
    shorter than 4 are filled by straight lines; a series of NaN alone that knows
    nothing outside stays so. Never below 0 where no reading is.
    """
    (count, n), missing = stack.shape, np.isnan(stack)
    outside = outside or [{}] * count
    out, converged = stack.copy(), np.ones(count, bool)
    todo = missing.any(1) & ~missing.all(1)
    for i in np.flatnonzero(missing.any(1)):
        filled = _start(stack[i], outside[i])
        if filled is not None:
            out[i] = filled
    rows = np.flatnonzero(todo)
    usable = list(dict.fromkeys((min(w, n // 2), r) for w, r in embeddings))
    if n < 4 or not len(rows):
        return out, converged
    best = np.zeros(len(rows), int)
    if len(usable) > 1:
        asked = ~missing[rows] & (np.cumsum(~missing[rows], 1) % ASKED == ASKED // 2)
        held = np.where(asked, np.nan, stack[rows])
        start = np.stack([_start(h, outside[i]) if not np.isnan(h).all() else out[i] for h, i in zip(held, rows)])
        errors = []
        for width, rank in usable:
            guess, _ = _rounds(start.copy(), np.isnan(held), width, rank, TRIED, tolerance)
            errors.append(np.where(asked, (guess - stack[rows]) ** 2, 0.0).sum(1))
        errors[0] = errors[0] * CLEARLY
        best = np.argmin(errors, 0)
    for k, (width, rank) in enumerate(usable):
        mine = rows[best == k]
        if len(mine):
            out[mine], converged[mine] = _rounds(out[mine], missing[mine], width, rank, rounds, tolerance)
    return out, converged


def _rounds(x: np.ndarray, missing: np.ndarray, width: int, rank: int, rounds: int, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Rounds of singular-spectrum imputation of a stack whose gaps have first values."""
    n = x.shape[1]
    index = np.arange(n - width + 1)[:, None] + np.arange(width)[None, :]
    counts = np.bincount(index.ravel(), minlength=n)
    known = np.where(missing, np.nan, x)
    floor = np.where(np.nanmin(known, 1) >= 0, 0.0, -np.inf)
    scale = np.maximum(np.nanstd(known, 1), 1e-9)
    converged, active = np.zeros(len(x), bool), np.arange(len(x))
    for _ in range(rounds):
        now, gone = x[active], missing[active]
        centre = now.mean(1, keepdims=True)
        h = (now - centre)[:, index]
        _, vectors = np.linalg.eigh(np.swapaxes(h, 1, 2) @ h)  # right singular vectors, ascending
        lead = vectors[:, :, -min(rank, width) :]
        smooth = (h @ lead) @ np.swapaxes(lead, 1, 2)
        back = np.zeros_like(now)
        for k in range(width):  # sums along the antidiagonals
            back[:, k : k + n - width + 1] += smooth[:, :, k]
        target = np.where(gone, np.maximum(back / counts + centre, floor[:, None]), now)
        moved = np.abs(target - now).max(1)
        done = moved < tolerance * scale
        # those that go on take a longer step, which halves the rounds; a settled one ends on the rebuilt values
        x[active] = np.where(gone & ~done[:, None], np.maximum(now + RELAX * (target - now), floor[:, None]), target)
        converged[active[done]] = True
        active, floor, scale = active[~done], floor[~done], scale[~done]
        if not len(active):
            break
    return x, converged


def impute(values: np.ndarray, outside: dict[int, float] | None = None, **how) -> np.ndarray:
    """One series with its NaN entries filled.

    outside: values of places before (negative) and after the series, towards which its ends lead.
    """
    return impute_stack(np.asarray(values, float)[None, :], [outside or {}], **how)[0][0]


OWN, SEEN, FAR = 0, 1, 2  # slots of a block, slots it sees of its neighbours, nearest readings beyond


def _fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offsets = batch.column("slots").offsets.to_numpy()
        cells = batch.column("slots").flatten()
        slot, value, n, own = (cells.field(k).to_numpy(zero_copy_only=False) for k in range(4))
        offsets = offsets - offsets[0]
        row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
        order = np.lexsort((slot, row))
        slot, value, n, own, row = slot[order], value[order].astype(float), n[order], own[order], row[order]
        far = own == FAR
        near = np.flatnonzero(~far)
        size = np.bincount(row[near], minlength=batch.num_rows)
        starts = np.cumsum(size) - size
        first = slot[near[np.minimum(starts, max(len(near) - 1, 0))]] if len(near) else np.zeros(batch.num_rows)
        outside: list[dict[int, float]] = [{} for _ in range(batch.num_rows)]
        for k in np.flatnonzero(far):
            outside[row[k]][int(slot[k] - first[row[k]])] = value[k]
        series, out, settled = value[near], value[near].copy(), np.ones(len(near), bool)
        for length in np.unique(size[size > 0]):
            rows = np.flatnonzero(size == length)
            for part in np.array_split(rows, -(-len(rows) * int(length) // 200_000)):
                at = starts[part][:, None] + np.arange(length)[None, :]
                filled, converged = impute_stack(series[at], [outside[i] for i in part])
                out[at], settled[at] = filled, converged[:, None]
        mine = own[near] == OWN
        keep = near[mine]
        keys = batch.column("run_id").take(pa.array(row[keep]))
        yield pa.RecordBatch.from_arrays(
            [keys, pa.array(slot[keep].astype(np.int32)), pa.array(out[mine], mask=np.isnan(out[mine])), pa.array(n[keep].astype(np.int64)), pa.array(n[keep] == 0), pa.array(settled[mine])],
            names=["run_id", "slot_no", "precip", "n_readings", "filled", "converged"],
        )


def regular_series(runs: DataFrame, readings: DataFrame, sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(run_id, slot_no, precip, n_readings, filled, converged)``: every slot of every run.

    Slot k lies at obs_start + k * accutime up to issuetime; a null accutime is
    the source's. precip is the mean of the slot's latest-received readings of
    each time, or the imputed value where ``filled``; it is null in a run without
    any reading. ``converged`` is false in a block whose filled values still moved
    after ROUNDS rounds; blocks of fewer than 4 slots are filled by straight lines. A reading counts for the nearest slot (halfway:
    the later one) if it has a time and a value that isn't NaN; others count
    nowhere. Rows stored twice count once. Runs without usable step or ends have
    no slots. Readings are counted per slot before they are gathered, and long
    runs are imputed in blocks that see the edges of their neighbours and the
    nearest reading beyond, so a task holds ``block`` slots of one and few more.
    """
    usual = require(sources, "source", "accutime").dropDuplicates(["source"]).withColumnRenamed("accutime", "usual")
    r = require(runs, "run_id", "source", "obs_start", "issuetime", "accutime").dropDuplicates(["run_id"]).join(usual, "source", "left")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    r = r.select("run_id", micros("obs_start").alias("t0"), micros("issuetime").alias("t1"), F.round(F.coalesce("accutime", "usual") * 60e6).cast("bigint").alias("step"))
    r = r.where("step > 0 and t1 >= t0").withColumn("last", F.expr("(t1 - t0) div step"))
    # in two steps, so that no row holds all slots of a run
    spine = r.select("run_id", "last", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"last div {SPREAD}"))).alias("_many"))
    spine = spine.select("run_id", "last", (F.col("_many") * SPREAD).alias("_from"), F.least("last", (F.col("_many") + 1) * SPREAD - 1).alias("_to"))
    spine = spine.select("run_id", "last", F.explode(F.sequence("_from", "_to")).alias("slot"), F.lit(None).cast("double").alias("sum"), F.lit(0).cast("bigint").alias("n"))
    o = require(readings, "reading_id", "run_id", "obs_timestamp", "received_at", "precip").where("obs_timestamp is not null and precip is not null and not isnan(precip)")
    o = o.select("run_id", micros("obs_timestamp").alias("ts"), "received_at", "reading_id", "precip")
    o = o.join(r.select("run_id", "t0", "step", "last"), "run_id").withColumn("slot", F.expr("floor((2 * (ts - t0) + step) / (2 * step))")).where("slot between 0 and last")
    # the latest revision of a time counts
    latest = o.groupBy("run_id", "slot", "ts").agg(F.max_by("precip", F.struct("received_at", "reading_id")).alias("v"))
    counted = latest.groupBy("run_id", "slot").agg(F.sum("v").alias("sum"), F.count("*").alias("n"))
    slots = spine.unionByName(counted, allowMissingColumns=True).groupBy("run_id", "slot").agg(F.sum("sum").alias("sum"), F.sum("n").alias("n"), F.max("last").alias("last"))
    edge = max(1, min(EDGE, block // 2))
    blocks = F.greatest(F.lit(1).cast("bigint"), F.floor((F.col("last") + 1 + block - edge) / block))
    slots = slots.select("run_id", F.col("slot").cast("int").alias("slot"), F.when(F.col("n") > 0, F.col("sum") / F.col("n")).alias("v"), "n", blocks.alias("blocks"))
    slots = slots.withColumn("block", F.least(F.floor(F.col("slot") / block), F.col("blocks") - 1))
    start, end = F.col("block") * block, (F.col("block") + 1) * block
    is_last = F.col("block") == F.col("blocks") - 1
    present = lambda *places: F.explode(F.filter(F.array(*places), lambda p: p.isNotNull()))
    place = lambda k, own: F.struct((F.col("block") + k).alias("block"), F.lit(own).alias("own"))
    seen = slots.withColumn("to", present(
        place(0, OWN),
        F.when((F.col("block") > 0) & (F.col("slot") < start + edge), place(-1, SEEN)),
        F.when(~is_last & (F.col("slot") >= end - edge), place(1, SEEN)),
    ))
    cells = seen.select("run_id", "to.block", F.struct("slot", "v", "n", F.col("to.own").alias("own")).alias("cell"))
    # the nearest readings beyond the slots that a block sees
    read = F.when(F.col("n") > 0, F.struct("slot", "v", "n", F.lit(FAR).alias("own")))
    ends = slots.where("blocks > 1").groupBy("run_id", "block").agg(F.min(read).alias("first"), F.max(read).alias("final"))
    w = Window.partitionBy("run_id").orderBy("block")
    back = Window.partitionBy("run_id").orderBy(F.desc("block"))
    left, right = F.last("final", True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.last("first", True).over(back.rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select("run_id", "block", left.alias("left"), right.alias("right"))
    ends = ends.select("run_id", "block", present(F.when(F.col("left.slot") < start - edge, F.col("left")), F.when(F.col("right.slot") >= end + edge, F.col("right"))).alias("cell"))
    cells = cells.unionAll(ends)
    grouped = cells.groupBy("run_id", "block").agg(F.collect_list("cell").alias("slots"))
    kind = runs.schema["run_id"].dataType.simpleString()
    return grouped.select("run_id", "slots").mapInArrow(_fill, f"run_id {kind}, slot_no int, precip double, n_readings bigint, filled boolean, converged boolean")
