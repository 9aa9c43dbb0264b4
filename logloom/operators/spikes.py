"""Implausible readings of a source (problem 6): impossible values, stuck values and spikes.

Each source is summarised by mergeable quantile sketches on a logarithmic scale (eight cells an octave, so a relative error of
under 5 %): first by hour, counted on the map side and merged over partitions, then by context. The context of an hour is the
narrowest of +-1, +-3, +-8 and +-24 hours that holds CONTEXT readings, else the whole record of the source. In a context the
cells where readings are dense form the habitual levels; there may be several (a second habitual level, both sides of a lasting
change). Each level has its expanded interquartile fences: its quartiles, FENCE interquartile ranges further out, the range being
taken as LEAST_RANGE cells at least, since quartiles of few readings can coincide. A reading outside the fences of every level is
a spike.

A reading inside the fences of a level can still come at an implausible rate: the steps from the reading before it and to the one
after it, in octaves, are held against the source's own steps in that context, by the same expanded fences. Where both lie outside,
in opposite directions, and its level holds too few readings to be a habit (HABIT), it is a spike as well. Sources that often change
between two levels have such steps among their own, so a second habitual level stays normal, as does a lasting change, which has one
such step only. Runs of equal readings (zero variance) are `stuck`; they don't count in the sketches.

A task sees the sketches of one source over ten days, or its readings of one hour, so no source is ever in one task.

Defined cases: null readings are no readings; NaN and infinite ones, negative ones and those over an hour are `impossible` and
nothing else; a repeated row counts once; a null source is a source of its own; a zero reading counts as the smallest cell; a source's
first and last readings have one step and so no rate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.entries import micros, source_key
from ..session import materialise
from .sequences import long_runs, partitions_of

HOUR_MS = 3_600_000.0
STUCK = 6
CELLS = 8  # an octave
CONTEXT = 40
RADII = (1, 3, 8, 24)
HOUR_US = 3_600_000_000
#: Hours of a source that one task judges together; their sketches come with those of RADII[-1] hours on both sides.
BLOCK, MARGIN = 192, 24

#: Interquartile ranges from the quartiles to the fences, the least such range in cells, and the share of a context that makes a habit.
FENCE, LEAST_RANGE, HABIT = 3.0, 3.0, 0.1


def readings(entries: DataFrame, value: str = "latency_ms") -> DataFrame:
    """entity, at (us), id, value: each non-null reading once."""
    return entries.where(F.col(value).isNotNull()).select(
        source_key("source").alias("entity"), micros("received_at").alias("at"), F.col("entry_id").alias("id"), F.col(value).cast("double").alias("value")
    )


def impossible(value: str = "value"):
    v = F.col(value)
    return F.isnan(v) | (v < 0) | (v > HOUR_MS)


def quartile_fences(counts):
    """The expanded interquartile fences of a sketch, in cells."""
    import numpy as np

    cum = np.cumsum(counts)
    q1, q3 = np.searchsorted(cum, [0.25 * cum[-1], 0.75 * cum[-1]])
    margin = FENCE * max(float(q3 - q1), LEAST_RANGE)
    return q1 - margin, q3 + margin


def levels_of(counts, floor: int = 4, share: float = 0.05):
    """The habitual levels of a sketch, given as an array of counts by cell: first and last cell within its fences, and its readings.

    A cell is dense if its octave on either side holds `share` of all readings and `floor` at least. Dense cells closer than
    half an octave form one level.
    """
    import numpy as np

    n = int(counts.sum())
    if n == 0:
        return []
    cum = np.concatenate([np.zeros(2 * CELLS + 1, np.int64), np.cumsum(counts), np.full(2 * CELLS, n)])
    near = cum[3 * CELLS + 1 : 3 * CELLS + 1 + len(counts)] - cum[CELLS : CELLS + len(counts)]
    dense = np.flatnonzero((counts > 0) & (near >= max(floor, share * n)))
    out = []
    for part in np.split(dense, np.flatnonzero(np.diff(dense) > CELLS // 2) + 1):
        if len(part):
            lo, hi = int(part[0]), int(part[-1])
            own = counts[lo : hi + 1]
            a, b = quartile_fences(own)
            out.append((lo + int(np.floor(a)), lo + int(np.ceil(b)), int(own.sum())))
    return out


CELLS_T = "array<struct<cell:int,n:bigint>>"
JUDGED = "entity string, hour bigint, inside array<struct<lo:int,hi:int,habit:boolean>>, step double"


def fences(hourly: DataFrame, whole: DataFrame) -> DataFrame:
    """Of sketches of readings (`cells`) and of their steps (`steps`) by (entity, hour), and of readings and steps by entity: rows of
    entity, hour, `inside`, the ranges of cells of the habitual levels, and `step`, the longest plausible step in cells."""
    n = partitions_of(hourly)
    spread = hourly.withColumn("block", F.explode(F.array_distinct(F.array(*(F.floor((F.col("hour") + d) / BLOCK) for d in (-MARGIN, 0, MARGIN))))))
    blocks = hourly.select(F.col("entity").alias("of"), F.floor(F.col("hour") / BLOCK).alias("on")).distinct()
    owned = blocks.join(whole.withColumnRenamed("entity", "of"), "of")  # a copy of a source's whole record for each of its blocks

    def run(key, pdf, record):
        import numpy as np
        import pandas as pd

        first, n_hours = int(key[1]) * BLOCK - MARGIN, BLOCK + 2 * MARGIN
        hours = pdf["hour"].to_numpy() - first if len(pdf) else np.array([], int)
        mine = sorted({int(x) for x in hours if MARGIN <= x < MARGIN + BLOCK})
        if not len(record) or not mine:
            return pd.DataFrame(columns=["entity", "hour", "inside", "step"], dtype=object)

        def contexts(column):
            """By hour the cumulated counts, the counts of the whole record, and the lowest cell."""
            pick = lambda cells: np.array([(c["cell"], c["n"]) for c in cells], np.int64).reshape(-1, 2)
            bins, all_ = [pick(c) if c is not None else np.zeros((0, 2), np.int64) for c in pdf[column]], pick(record[f"all_{column}"].iloc[0]) if record[f"all_{column}"].iloc[0] is not None else np.zeros((0, 2), np.int64)
            cells = np.concatenate([all_[:, 0], *(b[:, 0] for b in bins)])
            low, width = (int(cells.min()), int(cells.max() - cells.min()) + 1) if len(cells) else (0, 1)
            table, total = np.zeros((n_hours + 1, width), np.int64), np.zeros(width, np.int64)
            for h, b in zip(hours, bins, strict=True):
                np.add.at(table[int(h) + 1], b[:, 0] - low, b[:, 1])
            np.add.at(total, all_[:, 0] - low, all_[:, 1])
            return np.cumsum(table, axis=0), total, low

        cum, total, low = contexts("cells")
        step_cum, step_total, step_low = contexts("steps")
        rows = []
        for h in mine:
            chosen, steps = total, step_total
            for r in RADII:
                got = cum[min(h + r, n_hours - 1) + 1] - cum[max(h - r, 0)]
                if got.sum() >= CONTEXT:
                    chosen, steps = got, step_cum[min(h + r, n_hours - 1) + 1] - step_cum[max(h - r, 0)]
                    break
            n = int(chosen.sum())
            far = float(quartile_fences(steps)[1]) + step_low if steps.sum() else None
            inside = [{"lo": a + low, "hi": b + low, "habit": k >= HABIT * n} for a, b, k in levels_of(chosen)]
            rows.append((key[0], h + first, inside, far))
        return pd.DataFrame(rows, columns=["entity", "hour", "inside", "step"])

    # Partitions by number, so that this stage, which is all computing, isn't run by a few tasks because its data is small.
    left, right = spread.repartition(n, "entity", "block"), owned.repartition(n, "of", "on")
    return left.groupBy("entity", "block").cogroup(right.groupBy("of", "on")).applyInPandas(run, JUDGED)


def stepped(seen: DataFrame) -> DataFrame:
    """Readings (entity, hour, at, id, cell) with `before` and `after`, the cells of their neighbours: within an hour, and over its ends
    from the nearest hours that have readings."""
    place = F.struct("at", "id")
    ends = seen.groupBy("entity", "hour").agg(F.min_by("cell", place).alias("first"), F.max_by("cell", place).alias("last"))
    by_hour = Window.partitionBy("entity").orderBy("hour")  # a row an hour
    around = ends.select("entity", "hour", F.lag("last").over(by_hour).alias("_before"), F.lead("first").over(by_hour).alias("_after"))
    w = Window.partitionBy("entity", "hour").orderBy("at", "id")
    near = seen.withColumns({"before": F.lag("cell").over(w), "after": F.lead("cell").over(w)})
    return near.join(around, ["entity", "hour"]).withColumns({"before": F.coalesce("before", "_before"), "after": F.coalesce("after", "_after")}).drop("_before", "_after")


def sketched(rows: DataFrame, cell: Column, name: str) -> tuple[DataFrame, DataFrame]:
    """Counts by cell as arrays: by entity and hour, and by entity."""
    counts = rows.groupBy("entity", "hour", cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).where("cell is not null")
    hourly = counts.groupBy("entity", "hour").agg(F.collect_list(F.struct("cell", "n")).alias(name))
    return hourly, counts.groupBy("entity", "cell").agg(F.sum("n").alias("n")).groupBy("entity").agg(F.collect_list(F.struct("cell", "n")).alias(f"all_{name}"))


def faults(entries: DataFrame, value: str = "latency_ms") -> DataFrame:
    """entry_id and fault of every faulty reading; a stuck reading isn't also a spike."""
    all_ = readings(entries, value)
    bad = all_.where(impossible()).select("id", F.lit("impossible").alias("fault")).distinct()
    stuck = materialise(long_runs(all_, STUCK).where(~impossible()).select("id").distinct())
    cell = F.floor(F.log2(F.greatest("value", F.lit(1e-6))) * CELLS).cast("int")
    placed = all_.where(~impossible()).select("entity", F.floor(F.col("at") / HOUR_US).alias("hour"), "at", "id", cell.alias("cell"))
    # One shuffle by source and hour serves duplicates, neighbours and the join with the fences.
    seen = placed.repartition("entity", "hour").dropDuplicates(["entity", "hour", "at", "id"]).join(stuck, "id", "left_anti")
    seen = materialise(stepped(seen))
    hourly, whole = sketched(seen, F.col("cell"), "cells")
    hourly_steps, whole_steps = sketched(seen, F.abs(F.col("cell") - F.col("before")), "steps")
    judged = seen.join(fences(hourly.join(hourly_steps, ["entity", "hour"], "left"), whole.join(whole_steps, "entity", "left")), ["entity", "hour"])
    within = lambda x: F.col("cell").between(x["lo"], x["hi"])
    outside = ~F.exists("inside", within)
    into, out_of = F.col("cell") - F.col("before"), F.col("after") - F.col("cell")
    abrupt = (F.abs(into) > F.col("step")) & (F.abs(out_of) > F.col("step")) & (F.signum(into) != F.signum(out_of))
    rare = ~F.exists("inside", lambda x: within(x) & x["habit"])
    spikes = judged.where((F.size("inside") > 0) & (outside | (F.coalesce(abrupt, F.lit(False)) & rare))).select("id", F.lit("spike").alias("fault"))
    out = bad.unionByName(stuck.select("id", F.lit("stuck").alias("fault"))).unionByName(spikes)
    return out.select(F.col("id").alias("entry_id"), "fault")
