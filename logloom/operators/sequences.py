"""Runs of equal neighbours in long ordered sequences, without giving any entity to a single task.

Rows are range-partitioned by (entity, order), so an entity with a third of all rows is simply spread over many partitions.
One pass over each sorted partition finds its runs. A run that touches the edge of its partition may go on in the next; such
edge runs number at most two a partition, so joining them up is a window over a few rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise


def partitions_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def long_runs(df: DataFrame, least: int) -> DataFrame:
    """Of rows (entity string, at bigint, id bigint, value double): those in runs of `least` or more equal values in order of at.

    Rows with the same id and place are one row. NaN equals NaN. Result: entity, at, id, value.
    """
    parted = df.select("entity", "at", "id", "value").repartitionByRange(partitions_of(df), "entity", "at").sortWithinPartitions("entity", "at", "id")

    def scan(batches: Iterable) -> Iterator:
        import pandas as pd
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        run: list = []  # rows of the open run that are not emitted yet
        n, seq, key, last = 0, 0, None, None

        def out(rows: list, right: bool) -> list:
            done = [(*r, f"{part}-{seq}", seq == 0, right and i == len(rows) - 1, n) for i, r in enumerate(rows)]
            return done

        cols = ["entity", "at", "id", "value", "run", "left", "right", "n"]
        for pdf in batches:
            rows: list = []
            for e, a, i, v in zip(pdf["entity"], pdf["at"], pdf["id"], pdf["value"], strict=True):
                if (e, a, i) == last:
                    continue
                last = (e, a, i)
                k = (e, v if v == v else "nan")
                if k == key:
                    n += 1
                    run.append((e, a, i, v))
                    if n > least and len(run) > 1:  # surely long: all but the latest row can go
                        rows += out(run[:-1], False)
                        run = run[-1:]
                else:
                    if run and (n >= least or seq == 0):
                        rows += out(run, False)
                    if key is not None:
                        seq += 1
                    key, n, run = k, 1, [(e, a, i, v)]
            if rows:
                yield pd.DataFrame(rows, columns=cols)
        if run:
            yield pd.DataFrame(out(run, True), columns=cols)

    # Kept in a table, since the scan is long and its rows, those of long runs and of runs at borders, are few and used twice.
    runs = materialise(parted.mapInPandas(scan, "entity string, at bigint, id bigint, value double, run string, left boolean, right boolean, n int"))
    # A run is an edge run if it is the first or the last of its partition.
    edges = (
        runs.groupBy("run")
        .agg(F.max("left").alias("left"), F.max("right").alias("right"), F.min("entity").alias("entity"), F.min("value").alias("value"), F.min("at").alias("first"), F.max("n").alias("n"))
        .where("left or right")
    )
    w = Window.partitionBy("entity").orderBy("first", "run")
    same = F.lag("right").over(w) & F.col("left") & F.lag("value").over(w).eqNullSafe(F.col("value"))
    chained = edges.withColumn("chain", F.sum(F.when(same, 0).otherwise(1)).over(w))
    total = chained.withColumn("total", F.sum("n").over(Window.partitionBy("entity", "chain"))).select("run", "total")
    return runs.join(total, "run", "left").where(F.coalesce("total", "n") >= least).select("entity", "at", "id", "value")
