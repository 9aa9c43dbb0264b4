"""Schemas that drift between files (problem 4): one report of every change and one consistent table.

1. Leaves of the JSON objects and metadata maps are profiled by file and field: number of values by type, and a Theta sketch of
   the distinct values (both mergeable, so a file is profiled by many tasks). Nulls and absent fields have no type.
2. Each file is compared with the one before it in its feed. A field in both files with another type is `retyped`. Fields that go
   and fields that come within the same root and type are a bipartite graph, weighted by the overlap of their value sketches and,
   to settle ties, the likeness of their names; the best assignment gives the renamed fields. The rest was added or removed.
3. Chains of renames give each field one column for all files of the feed; records are read into those columns, by one type each.

What is matched or chained in one task are fields, never records.

Defined cases: text that isn't a JSON object has no fields; a field that is only ever null in a file counts as absent; empty
objects have no fields; rows delivered twice change nothing; files are ordered by file_seq, not by time; the first file of a
feed is compared with nothing; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import broadcast_if_small, materialise

#: Share of the smaller field's values that both must carry to be one field.
OVERLAP = 0.5


#: Levels of nesting that are opened in the engine itself; what lies deeper, as a rule nothing, goes through Python.
LEVELS = 4


def kind_of(value: Column) -> Column:
    """The type of a JSON value; null for null, `object` for an object. JSON integers come as BIGINT, or beyond it as decimals of more
    than 18 digits; a decimal like 1.0 has fewer."""

    def named(t: Column) -> Column:
        return (
            F.when(t == "STRING", "text").when(t == "BIGINT", "integer").when(t == "BOOLEAN", "boolean").when(t.startswith("OBJECT"), "object").when(t.startswith("ARRAY"), "array")
            .when(t.rlike(r"^DECIMAL\((?:19|[23]\d),0\)$"), "integer").when(t.startswith("DECIMAL") | t.isin("DOUBLE", "FLOAT"), "fraction")
        )

    return F.transform(F.array(F.schema_of_variant(value)), named)[0]  # so that the schema is worked out once


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("name", "json")])))
def deep_leaves(texts):
    """Names, with dots, and JSON of the leaves of objects."""
    import json

    def flat(before, d):
        for k, v in d.items():
            if isinstance(v, dict):
                yield from flat(f"{before}{k}.", v)
            else:
                yield {"name": before + k, "json": json.dumps(v)}

    return texts.map(lambda t: list(flat("", json.loads(t))))


def fields(records: DataFrame) -> DataFrame:
    """A row for each non-null leaf: record_id, file_id, root, name, type, value (text) and json (VARIANT)."""
    ids = ["record_id", "file_id"]
    told = _opened(records).where("type <> 'object'")
    # Only records with so many brackets can be nested deeper, which is looked at before any is parsed for it.
    nested = _opened(records.where(F.regexp_count("structured", F.lit(r"\{")) > LEVELS)).where("type = 'object'")
    deep = nested.select(*ids, "name", F.explode(deep_leaves(F.to_json("json"))).alias("x")).select(*ids, F.concat_ws(".", "name", "x.name").alias("name"), F.try_parse_json("x.json").alias("json"))
    told = told.select(*ids, "name", "json", "type").unionByName(deep.withColumn("type", kind_of(F.col("json"))).where("type is not null"))
    structured = told.select(*ids, F.lit("structured").alias("root"), "name", "type", F.coalesce(F.try_variant_get("json", "$", "string"), F.to_json("json")).alias("value"), "json")
    meta = records.select(*ids, F.explode("metadata").alias("name", "value")).where("value is not null")
    return structured.unionByName(meta.select(*ids, F.lit("metadata").alias("root"), "name", F.lit("text").alias("type"), "value", F.col("value").cast("variant").alias("json")))


def _opened(records: DataFrame) -> DataFrame:
    """The leaves down to LEVELS, and the objects at that level, by one pass over the records: each level opens those of the one before."""
    tvf = records.sparkSession.tvf
    ids = ["record_id", "file_id"]
    rows = records.select(*ids, F.try_parse_json(F.col("structured")).alias("_top")).lateralJoin(tvf.variant_explode(F.col("_top").outer())).where("key is not null")
    rows = rows.select(*ids, F.col("key").alias("name"), F.col("value").alias("json")).withColumn("type", kind_of(F.col("json")))
    for _ in range(LEVELS - 1):
        inner = rows.withColumn("_in", F.when(F.col("type") == "object", F.col("json"))).lateralJoin(tvf.variant_explode_outer(F.col("_in").outer()))
        opened = F.col("key").isNotNull()
        rows = inner.select(
            *ids, F.when(opened, F.concat_ws(".", "name", "key")).otherwise(F.col("name")).alias("name"), F.when(opened, F.col("value")).otherwise(F.col("json")).alias("json"),
            F.when(opened, kind_of(F.col("value"))).otherwise(F.col("type")).alias("type"),
        )
    return rows.where("type is not null")


def profiles(records: DataFrame) -> DataFrame:
    """By file and field: its type (the most frequent one) and a sketch of its values."""
    by_type = fields(records).groupBy("file_id", "root", "name", "type").agg(F.count(F.lit(1)).alias("n"), F.theta_sketch_agg("value").alias("sketch"))
    return by_type.groupBy("file_id", "root", "name").agg(F.max_by(F.struct("type", "sketch"), F.struct("n", "type")).alias("p")).select("file_id", "root", "name", "p.type", "p.sketch")


def assign(weights):
    """The assignment of greatest total weight of a matrix with non-negative weights (Hungarian method): column by row, or -1."""
    import numpy as np

    rows, cols = weights.shape
    n = max(rows, cols)
    cost = np.zeros((n + 1, n + 1))
    cost[1 : rows + 1, 1 : cols + 1] = -weights
    u, v, match = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        slack, way, used = np.full(n + 1, np.inf), np.zeros(n + 1, int), np.zeros(n + 1, bool)
        while True:
            used[j0] = True
            i0 = match[j0]
            reduced = cost[i0] - u[i0] - v
            better = ~used & (reduced < slack)
            better[0] = False
            slack[better], way[better] = reduced[better], j0
            free = np.where(used, np.inf, slack)
            free[0] = np.inf
            j1 = int(np.argmin(free))
            delta = free[j1]
            u[match[used]] += delta
            v[used] -= delta
            slack[~used] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    out = np.full(rows, -1)
    for j in range(1, cols + 1):
        if 1 <= match[j] <= rows and weights[match[j] - 1, j - 1] > 0:
            out[match[j] - 1] = j - 1
    return out


def _likeness(a: Column, b: Column) -> Column:
    """How alike two names are, 0 to 1, without regard to case and underscores."""
    x, y = (F.regexp_replace(F.lower(c), "[_.-]", "") for c in (a, b))
    inside = x.contains(y) | y.contains(x)
    return F.when(inside, F.lit(0.9)).otherwise(1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y), F.lit(1)))


def changes(records: DataFrame, files: DataFrame) -> DataFrame:
    """file_id, root, change, field_before, field_after: each difference between a file and the one before it."""
    known, gone, come, retyped = _steps(records, files)
    renamed = _renamed(records, gone, come)
    removed = gone.join(renamed, ["file_id", "root", "field_before"], "left_anti").select("file_id", "root", F.lit("removed").alias("change"), "field_before", F.lit("").alias("field_after"))
    added = come.join(renamed, ["file_id", "root", "field_after"], "left_anti").select("file_id", "root", F.lit("added").alias("change"), F.lit("").alias("field_before"), "field_after")
    return retyped.unionByName(renamed).unionByName(removed).unionByName(added)


def _compared(records: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The profiles of all files and the renamed fields."""
    known, gone, come, _ = _steps(records, files)
    return known, _renamed(records, gone, come)


def _steps(records: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The profiles, and by file the fields that went, those that came and those of another type."""
    order = Window.partitionBy("feed").orderBy("file_seq", "file_id")
    steps = files.select("file_id", "feed", "file_seq").dropDuplicates(["file_id"]).withColumn("before_id", F.lag("file_id").over(order)).where("before_id is not null")
    known = materialise(profiles(records))
    now = steps.select("file_id").join(known, "file_id").select("file_id", "root", "name", F.col("type").alias("type_now"), F.col("sketch").alias("now"))
    then = steps.select("file_id", "before_id").join(known.withColumnRenamed("file_id", "before_id"), "before_id").select("file_id", "root", "name", F.col("type").alias("type_then"), F.col("sketch").alias("then"))
    both = then.join(now, ["file_id", "root", "name"], "full")
    retyped = both.where("type_now <> type_then").select("file_id", "root", F.lit("retyped").alias("change"), F.col("name").alias("field_before"), F.col("name").alias("field_after"))
    gone = both.where("type_now is null").select("file_id", "root", F.col("type_then").alias("type"), F.col("name").alias("field_before"), "then")
    come = both.where("type_then is null").select("file_id", "root", F.col("type_now").alias("type"), F.col("name").alias("field_after"), "now")
    return known, gone, come, retyped


def _renamed(records: DataFrame, gone: DataFrame, come: DataFrame) -> DataFrame:
    least = F.least(F.theta_sketch_estimate("then"), F.theta_sketch_estimate("now"))
    shared = F.theta_sketch_estimate(F.theta_intersection("then", "now")) / F.greatest(least, F.lit(1))
    edges = gone.join(come, ["file_id", "root", "type"]).withColumn("overlap", shared).where(F.col("overlap") >= OVERLAP)
    edges = edges.select("file_id", "root", "field_before", "field_after", (F.col("overlap") + 0.5 * _likeness(F.col("field_before"), F.col("field_after"))).alias("weight"))

    def match(pdf):
        import numpy as np
        import pandas as pd

        a, b = sorted(set(pdf["field_before"])), sorted(set(pdf["field_after"]))
        w = np.zeros((len(a), len(b)))
        at, to = {x: i for i, x in enumerate(a)}, {x: i for i, x in enumerate(b)}
        for x, y, s in zip(pdf["field_before"], pdf["field_after"], pdf["weight"], strict=True):
            w[at[x], to[y]] = s
        hit = [(a[i], b[j]) for i, j in enumerate(assign(w)) if j >= 0]
        return pd.DataFrame([(pdf["file_id"].iloc[0], pdf["root"].iloc[0], "renamed", x, y) for x, y in hit], columns=["file_id", "root", "change", "field_before", "field_after"])

    schema = T.StructType([records.schema["file_id"], *(T.StructField(c, T.StringType()) for c in ("root", "change", "field_before", "field_after"))])
    return materialise(edges.groupBy("file_id", "root").applyInPandas(match, schema))


def chains(known: DataFrame, files: DataFrame, renames: DataFrame) -> DataFrame:
    """The column of each field of each file, and its type: file_id, root, name, column, column_type.

    A field goes on as the column it had in the file before, under its old name or as what it was renamed to; one that goes leaves its
    column, and one that comes has a column of its own, or takes up again the one that was left by its name and type. So no two fields
    of a file have one column. A column has the name its field had first; where another column has it, the number of the file is
    added. Its type is that of all its fields, `fraction` for both kinds of numbers and `text` for any other mixture.
    """
    of_file = files.select("file_id", "feed", "file_seq").dropDuplicates(["file_id"])
    before = renames.select("file_id", "root", F.col("field_after").alias("name"), F.col("field_before").alias("before"))
    rows = known.select("file_id", "root", "name", "type").join(of_file, "file_id").join(before, ["file_id", "root", "name"], "left")

    def chain(pdf):
        import pandas as pd

        out, types, used = [], {}, set()
        active: dict[str, str] = {}  # name in the latest file to column
        left: dict[tuple[str, str], str] = {}  # name and type of a field that went to its column
        for _, part in pdf.sort_values(["file_seq", "file_id", "name"]).groupby(["file_seq", "file_id"], sort=True):
            now: dict[str, str] = {}
            fields = list(zip(part["file_id"], part["root"], part["name"], part["type"], part["before"], part["file_seq"], strict=True))
            for _, _, name, _, old, _ in fields:  # fields that go on come first
                source = old if isinstance(old, str) else name
                if source in active and (isinstance(old, str) or name not in {x for *_, x, _ in fields if isinstance(x, str)}):
                    now[name] = active[source]
            for file_id, root, name, kind, _, seq in fields:
                if name not in now:
                    column = left.get((name, kind))
                    if column is None or column in now.values():
                        column = name if name not in used else f"{name}@{seq}"
                        while column in used:
                            column += "+"
                    used.add(column)
                    now[name] = column
                types.setdefault(now[name], set()).add(kind)
                out.append((file_id, root, name, now[name]))
                left[name, kind] = now[name]
            active = now
        one = {c: next(iter(t)) if len(t) == 1 else "fraction" if t == {"integer", "fraction"} else "text" for c, t in types.items()}
        return pd.DataFrame([(*r, one[r[3]]) for r in out], columns=["file_id", "root", "name", "column", "column_type"])

    kind = T.StructType([known.schema["file_id"], *(T.StructField(c, T.StringType()) for c in ("root", "name", "column", "column_type"))])
    return rows.groupBy("feed", "root").applyInPandas(chain, kind)  # fields of files, not records


def unified(records: DataFrame, files: DataFrame) -> DataFrame:
    """record_id, file_id, columns: every record once, its leaves as a VARIANT object under the column, and of the type, that each has
    in all files of the feed. Fields of files that aren't listed keep their names."""
    every = records.dropDuplicates(["record_id"])
    known, renames = _compared(records, files)
    named = materialise(chains(known, files, renames))
    flat = fields(every).join(broadcast_if_small(named), ["file_id", "root", "name"], "left")
    kind = F.col("column_type")
    number = F.try_variant_get("json", "$", "double")
    value = F.when((kind == "fraction") & (F.col("type") == "integer"), number.cast("variant")).when((kind == "text") & (F.col("type") != "text"), F.col("value").cast("variant")).otherwise(F.col("json"))
    key = F.concat_ws(".", "root", F.coalesce("column", "name"))
    held = flat.groupBy("record_id").agg(F.to_variant_object(F.map_from_entries(F.collect_list(F.struct(key.alias("key"), value.alias("value"))))).alias("columns"))
    empty = F.parse_json(F.lit("{}"))
    return every.select("record_id", "file_id").join(held, "record_id", "left").withColumn("columns", F.coalesce("columns", empty))
