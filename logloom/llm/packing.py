"""Filling fixed-capacity containers (problem 9) by harmonic packing.

An item of size s with C/(j+1) < s <= C/j belongs to class j, and any j items of class j fit a container of capacity C.
A container is therefore begun with j items of one class, the count alone deciding, and what its items leave free, up to
C/(j+1), is filled with items of smaller classes, the largest that fits first. Classes are taken in order, from the largest items to
the smallest; fewer than j items that are left of a class begin a container in the same way. Items above C are cut into pieces of
exactly C and a rest, the only case in which an item is split.

Items are dealt to shards of about SHARD_ITEMS items by hash, each of which is packed independently by one task that sees ids and
sizes only. So a class that holds most of the corpus is packed by many tasks; a shard leaves one container badly filled at most.

Defined cases: null and empty texts are items of size 0, which add to a shard's last container; an id delivered twice with the same
size is one item; extra columns are dropped; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise
from .tokenize import count_tokens

CAPACITY = 8192
SHARD_ITEMS = 200_000


def containers(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Of items with sizes up to the capacity: the container of each, and the class that each container was begun with (0 for items of
    size 0 alone)."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    distinct = sorted({s for s in sizes if s > 0})
    held: dict[int, list[int]] = {s: [] for s in distinct}
    for i in reversed(order):
        if sizes[i] > 0:
            held[sizes[i]].append(i)
    #: The place of the largest size at or below each place that still has items, with short cuts.
    below = list(range(len(distinct)))

    def largest(at: int) -> int:
        path = []
        while at >= 0 and below[at] != at:
            path.append(at)
            at = below[at]
        for p in path:
            below[p] = at
        return at

    into, begun = [0] * len(sizes), []
    top = largest(len(distinct) - 1)

    def take(at: int) -> int:
        s = distinct[at]
        into[held[s].pop()] = len(begun)
        if not held[s]:
            below[at] = at - 1
        return s

    while top >= 0:
        j = capacity // distinct[top]
        room, n = capacity, 0
        while n < j and (top := largest(top)) >= 0 and capacity // distinct[top] == j:
            room -= take(top)
            n += 1
        while room > 0 and (at := largest(bisect_right(distinct, room) - 1)) >= 0:
            room -= take(at)
        begun.append(j)
        top = largest(top) if top >= 0 else -1
    if any(s == 0 for s in sizes):
        if not begun:
            begun.append(0)
        for i, s in enumerate(sizes):
            if s == 0:
                into[i] = len(begun) - 1
    return into, begun


def pack(items: DataFrame, id_col: str, size_col: str, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """Rows of id, piece (from 0), n_tokens, bin_class, bin_id: every item once, or as pieces where it exceeds the capacity. bin_class
    is the class its container was begun with."""
    if capacity < 1:
        raise ValueError("the capacity must be at least one")
    size = F.greatest(F.coalesce(F.col(size_col), F.lit(0)).cast("long"), F.lit(0).cast("long"))
    whole = materialise(items.select(F.col(id_col), size.alias("size")).dropDuplicates([id_col, "size"]))  # so that texts are measured once
    shards = max(1, -(-whole.count() // shard_items))
    last = F.greatest(F.ceil(F.col("size") / capacity) - 1, F.lit(0))
    pieces = whole.select(id_col, "size", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("piece")).select(
        id_col, F.col("piece").cast("int").alias("piece"), F.least(F.lit(capacity), F.col("size") - F.col("piece") * capacity).cast("long").alias("n_tokens")
    )
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64(id_col, "piece"), F.lit(shards)).cast("int"))
    kind = T.StructType([items.schema[id_col], *(T.StructField(c, t) for c, t in (("piece", T.IntegerType()), ("n_tokens", T.LongType()), ("bin_class", T.IntegerType()), ("bin_id", T.StringType())))])

    def fill(pdf):
        pdf = pdf.sort_values(["n_tokens", id_col, "piece"], ascending=[False, True, True])
        into, begun = containers(pdf["n_tokens"].tolist(), capacity)
        shard = pdf["shard"].iloc[0]
        return pdf.assign(bin_class=[begun[k] for k in into], bin_id=[f"{begun[k]}-{shard}-{k}" for k in into])[[id_col, "piece", "n_tokens", "bin_class", "bin_id"]]

    return dealt.groupBy("shard").applyInPandas(fill, kind)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """Documents as items, measured in tokens of a public tokenizer."""
    return pack(count_tokens(docs, path=path), "doc_id", "n_tokens", capacity)


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """By the class that containers were begun with: containers, pieces, tokens and the share of the capacity used."""
    bins = packed.groupBy("bin_id").agg(F.count(F.lit(1)).alias("items"), F.sum("n_tokens").alias("tokens"))
    return bins.groupBy(F.substring_index("bin_id", "-", 1).alias("kind")).agg(
        F.count(F.lit(1)).alias("n_bins"), F.sum("items").alias("n_items"), F.sum("tokens").alias("n_tokens"),
        F.max("tokens").alias("fullest"), F.round(F.sum("tokens") / (F.count(F.lit(1)) * F.lit(capacity)), 6).alias("fill"),
    )
