"""Runs of repeated consecutive events (problem 2) by adjacent agglomeration.

Every entity's events lie in order in a doubly linked list of runs. A priority queue holds the neighbouring pairs that meet
the similarity and gap limits, the most similar first; the best pair is merged, its neighbours are compared with the new run,
and so on until no pair meets the limits. Similarity is that of the runs' contents without stamps, numbers and machine-made
ids: 1 where nothing else differs, else the share of equal words at equal places.

Equal neighbours are always the most similar, so they are merged first whatever the limits. Rows are range-partitioned by (entity,
time) for that, so that an entity with a third of all rows is spread over many partitions; what is left at the borders, two runs a
partition at most, is joined up afterwards. With a similarity below 1 the runs so found are then agglomerated by stretches: no run
reaches over a pause longer than the gap limit, and merging changes no pause, so a stretch between two such pauses can be
agglomerated on its own. The result is that of one queue over the whole sequence, however the rows are partitioned. A similarity
below 1 therefore needs a gap limit.

Defined cases: rows delivered twice count once; entries without content are alike (their content counts as empty); a null
source is an entity of its own; entries with the same time are ordered by id; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.entries import micros, source_key
from ..operators.sequences import partitions_of
from ..session import materialise

# Fixed forms of what may differ between repeated events, in the order in which they are blanked.
MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
DAYS = "Mon|Tue|Wed|Thu|Fri|Sat|Sun"
BLANKED = (
    rf"\b(?:(?:{DAYS}),? +)?(?:{MONTHS}) +\d{{1,2}},? (?:\d{{4}} )?\d{{1,2}}:\d{{2}}:\d{{2}}(?:[.,]\d+)?(?: [AP]M)?(?: [A-Z]{{3,4}})?\b",
    rf"\b\d{{1,2}}[/ -](?:{MONTHS})[/ -]\d{{4}}[: ]\d{{2}}:\d{{2}}:\d{{2}}(?:[.,]\d+)?(?: [+-]\d{{4}})?",
    r"\b\d{4}[-/]\d{2}[-/]\d{2}(?:[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?: ?(?:Z|[+-]\d{2}:?\d{2}))?)?",
    r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b",
    r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b",
    r"\b0[xX][0-9a-fA-F]+\b",
    r"\b(?=[0-9]*[a-f])[0-9a-f]{6,}\b|\b(?=[0-9]*[A-F])[0-9A-F]{6,}\b",
    r"(?:(?<=[=\s(\[:])[-+])?\d+(?:[.,]\d+)*",
)


def blank(content: Column) -> Column:
    """The content with stamps, numbers and machine-made ids as `#`."""
    out = F.coalesce(content.cast("string"), F.lit(""))
    for form in BLANKED:
        out = F.regexp_replace(out, form, "#")
    return out


def similarity(a: str, b: str) -> float:
    """1 for equal templates, else the share of equal words at equal places of the longer one."""
    if a == b:
        return 1.0
    x, y = a.split(), b.split()
    return sum(p == q for p, q in zip(x, y, strict=False)) / max(len(x), len(y), 1) * 0.999


def agglomerate(events: list[tuple], least: float, gap_us: int | None) -> list[list]:
    """Runs [first at, first id, last at, last id, n, template] of events (at, id, template) in order."""
    return agglomerate_runs([[a, i, a, i, 1, t] for a, i, t in events], least, gap_us)


def agglomerate_runs(runs: list[list], least: float, gap_us: int | None) -> list[list]:
    """The same of runs in order, which are changed. Of equally similar pairs the closer one is merged first, then the earlier one."""
    import heapq

    n = len(runs)
    prev, nxt, alive, version = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n, [0] * n
    heap: list[tuple] = []

    def offer(i: int, j: int) -> None:
        gap = runs[j][0] - runs[i][2]
        if gap_us is not None and gap > gap_us:
            return
        if runs[i][5] == runs[j][5]:
            s = 1.0
        elif least >= 1.0:
            return
        else:
            s = similarity(runs[i][5], runs[j][5])
        if s >= least:
            heapq.heappush(heap, (-s, gap, i, j, version[i], version[j]))

    for i in range(n - 1):
        offer(i, i + 1)
    while heap:
        _, _, i, j, vi, vj = heapq.heappop(heap)
        if not (alive[i] and alive[j] and version[i] == vi and version[j] == vj):
            continue
        a, b = runs[i], runs[j]
        if b[4] > a[4]:
            a[5] = b[5]  # the template of the larger side stands for both
        a[2], a[3], a[4] = b[2], b[3], a[4] + b[4]
        alive[j] = False
        version[i] += 1
        nxt[i] = nxt[j]
        if nxt[j] >= 0:
            prev[nxt[j]] = i
            offer(i, nxt[i])
        if prev[i] >= 0:
            offer(prev[i], i)
    return [r for r, live in zip(runs, alive, strict=True) if live]


#: Equal events are merged over so many of an entity at once; a longer piece of a partition is cut and joined up again.
BLOCK = 100_000

#: Time in which the runs of an entity are put in order by one task, to find its pauses.
HOUR_US = 3_600_000_000

RUNS = "entity string, first_at bigint, first_id bigint, last_at bigint, last_id bigint, n bigint, template string, left boolean, right boolean"


def runs(entries: DataFrame, least: float = 1.0, gap_us: int | None = None, id_col: str = "entry_id") -> DataFrame:
    """All runs: entity, first_id, last_id, n_events, duration_us, template; a single event is a run of one."""
    if least < 1 and gap_us is None:
        raise ValueError("a similarity below 1 needs a gap limit")
    found = _equal(entries, gap_us, id_col)
    return _shown(found if least >= 1 else _near(found, least, gap_us))


def _shown(found: DataFrame) -> DataFrame:
    return found.select("entity", F.col("first_id").alias("first_entry_id"), F.col("last_id").alias("last_entry_id"), F.col("n").alias("n_events"), (F.col("last_at") - F.col("first_at")).alias("duration_us"), "template")


def _equal(entries: DataFrame, gap_us: int | None, id_col: str, at_least: int = 1) -> DataFrame:
    """Runs of so many equal events at least, kept in a table, so that the events are read once for runs inside of partitions and at
    their borders."""
    events = entries.select(source_key("source").alias("entity"), micros("received_at").alias("at"), F.col(id_col).cast("long").alias("id"), "content")
    parted = events.repartitionByRange(partitions_of(entries), "entity", "at").sortWithinPartitions("entity", "at", "id")
    blanked = parted.select("entity", F.coalesce("at", F.lit(-(1 << 62))).alias("at"), "id", blank(F.col("content")).alias("template"))

    def scan(batches: Iterable) -> Iterator:
        import pandas as pd

        cols = [c.split()[0] for c in RUNS.split(", ")]
        entity, block, last = None, [], None
        held: list = []  # the latest run, kept back until it is known whether the partition ends with it
        first = True

        def flush() -> list:
            nonlocal first, held, block
            out: list = []
            if block:
                rows = [[entity, *r] for r in agglomerate(block, 1.0, gap_us)]
                if held and held[0][0] == entity and held[0][6] == rows[0][6] and (gap_us is None or rows[0][1] - held[0][3] <= gap_us):
                    h, r = held[0], rows.pop(0)
                    h[3], h[4], h[5] = r[3], r[4], h[5] + r[5]
                if rows:
                    out = [*held, *([*r, False] for r in rows[:-1])]
                    held = [[*rows[-1], False]]
                    if first:
                        (out or held)[0][7] = True
                        first = False
            block = []
            return out

        for pdf in batches:
            done: list = []
            for e, a, i, t in zip(pdf["entity"], pdf["at"], pdf["id"], pdf["template"], strict=True):
                if (e, a, i) == last:
                    continue
                last = (e, a, i)
                if e != entity or len(block) >= BLOCK:
                    done += flush()
                    entity = e
                block.append((a, i, t))
            if done := [[*r, False] for r in done if r[5] >= at_least or r[7]]:
                yield pd.DataFrame(done, columns=cols)
        done = [[*r, False] for r in flush() if r[5] >= at_least or r[7]] + [[*r, True] for r in held]
        if done:
            yield pd.DataFrame(done, columns=cols)

    found = materialise(blanked.mapInPandas(scan, RUNS))
    return found.where("not (left or right)").drop("left", "right").unionByName(_join_up(found.where("left or right"), gap_us)).where(F.col("n") >= at_least)


def _join_up(edges: DataFrame, gap_us: int | None) -> DataFrame:
    """Runs at partition borders, of which there are two a partition at most, joined where the next one goes on."""
    w = Window.partitionBy("entity").orderBy("first_at", "first_id")
    before = F.lag(F.struct("last_at", "template", "right")).over(w)
    near = F.lit(True) if gap_us is None else (F.col("first_at") - before["last_at"] <= gap_us)
    goes_on = before["right"] & F.col("left") & near & (F.col("template") == before["template"])
    chained = edges.withColumn("new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("chain", F.sum("new").over(w))
    return chained.groupBy("entity", "chain").agg(
        F.min("first_at").alias("first_at"), F.min_by("first_id", F.struct("first_at", "first_id")).alias("first_id"), F.max("last_at").alias("last_at"),
        F.max_by("last_id", F.struct("last_at", "last_id")).alias("last_id"), F.sum("n").alias("n"), F.first("template").alias("template"),
    ).drop("chain")


def stretches(found: DataFrame, gap_us: int) -> DataFrame:
    """The runs with `stretch`, the time at which the stretch without a longer pause began that they are in: within an hour, and over
    its ends from the hours before."""
    placed = found.withColumn("_hour", F.floor(F.col("first_at") / HOUR_US))
    here, by_hour = Window.partitionBy("entity", "_hour").orderBy("first_at", "first_id"), Window.partitionBy("entity").orderBy("_hour")
    hours = placed.groupBy("entity", "_hour").agg(F.max("last_at").alias("_end"))
    ended = hours.select("entity", "_hour", F.lag("_end").over(by_hour).alias("_end"))  # a row an hour
    before = F.coalesce(F.lag("last_at").over(here), F.col("_end"))
    cut = placed.join(ended, ["entity", "_hour"]).withColumn("_cut", F.when(before.isNull() | (F.col("first_at") - before > gap_us), F.col("first_at")))
    latest = cut.groupBy("entity", "_hour").agg(F.max("_cut").alias("_begun"))
    begun = latest.select("entity", "_hour", F.last("_begun", ignorenulls=True).over(by_hour.rowsBetween(Window.unboundedPreceding, -1)).alias("_begun"))
    stretch = F.coalesce(F.last("_cut", ignorenulls=True).over(here.rowsBetween(Window.unboundedPreceding, 0)), F.col("_begun"))
    return cut.join(begun, ["entity", "_hour"]).withColumn("stretch", stretch).drop("_hour", "_end", "_cut", "_begun")


def _near(found: DataFrame, least: float, gap_us: int) -> DataFrame:
    """Runs of near-equal events, from those of equal ones."""
    cols = ["entity", "first_at", "first_id", "last_at", "last_id", "n", "template"]
    parted = stretches(found, gap_us).repartition("entity", "stretch").sortWithinPartitions("entity", "stretch", "first_at", "first_id")

    def scan(batches: Iterable) -> Iterator:
        import pandas as pd

        key, held = None, []

        def flush() -> list:
            return [[key[0], *r] for r in agglomerate_runs(held, least, gap_us)] if held else []

        for pdf in batches:
            done: list = []
            for entity, stretch, *run in zip(pdf["entity"], pdf["stretch"], *(pdf[c] for c in cols[1:]), strict=True):
                if (entity, stretch) != key:
                    done += flush()
                    key, held = (entity, stretch), []
                held.append(run)
            if done:
                yield pd.DataFrame(done, columns=cols)
        if held:
            yield pd.DataFrame(flush(), columns=cols)

    return parted.select(*cols, "stretch").mapInPandas(scan, "entity string, first_at bigint, first_id bigint, last_at bigint, last_id bigint, n bigint, template string")


def repeated(entries: DataFrame) -> DataFrame:
    """Stretches of two or more entries that differ in nothing but stamps, numbers and ids."""
    return _shown(_equal(entries, None, "entry_id", 2)).select("first_entry_id", "last_entry_id", "n_events", "duration_us")
