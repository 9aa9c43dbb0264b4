"""The chain of modules that turns raw lines into enriched ones. Every module is a function from DataFrame to DataFrame, so the
whole chain is one projection that Spark fuses; it reads the content only, so the order of modules doesn't matter."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Config, Modules
from ..errors import PipelineError
from ..operators import latency, pattern, parser, security
from ..session import prepare

Module = Callable[[DataFrame], DataFrame]


def passthrough(df: DataFrame) -> DataFrame:
    return df


def pattern_module(config: Modules) -> Module:
    c = config.pattern_detection
    return lambda df: pattern.with_tags(pattern.with_error_code(pattern.with_level(df, enabled=c.detect_levels), enabled=c.detect_error_codes), c.custom_patterns)


def parser_module(config: Modules) -> Module:
    c = config.structural_parser
    return lambda df: parser.with_structured(df, c.auto_detect, c.format)


def performance_module(config: Modules) -> Module:
    return lambda df: latency.with_latency(df, config.performance_metrics.latency_patterns)


def security_module(config: Modules) -> Module:
    return lambda df: security.with_security_flags(df, config.security)


ERROR = "error"


def row_module(fn: Callable[[dict], dict], inputs: Sequence[str], outputs: T.StructType | str) -> Module:
    """A module from a Python function of a line, given as a dict of `inputs`, to a dict of `outputs`. A line for which it raises has
    its message in `error`, nulls in the outputs, and is left alone by later modules of this kind; the other lines go on."""
    kind = outputs if isinstance(outputs, T.StructType) else T._parse_datatype_string(outputs)
    names = kind.names
    result = T.StructType([*kind.fields, T.StructField(ERROR, T.StringType())])

    @F.pandas_udf(result)
    def run(rows):  # Arrow batches; no type hints: Spark's default is Series to Series, here frames
        import pandas as pd

        out = []
        for row in rows.to_dict("records"):
            if row.pop(ERROR, None) is not None:
                out.append(None)
                continue
            try:
                made = fn(row)
                out.append({**{n: made.get(n) for n in names}, ERROR: None})
            except Exception as e:  # one line fails, not the batch
                out.append({**dict.fromkeys(names), ERROR: f"{type(e).__name__}: {e}"})
        blank = dict.fromkeys([*names, ERROR])
        return pd.DataFrame([x or blank for x in out], columns=[*names, ERROR])

    def module(df: DataFrame) -> DataFrame:
        before = F.col(ERROR) if ERROR in df.columns else F.lit(None).cast("string")
        made = df.withColumn("_made", run(F.struct(*inputs, before.alias(ERROR))))
        return made.withColumns({**{n: F.col(f"_made.{n}") for n in names}, ERROR: F.coalesce(before, F.col(f"_made.{ERROR}"))}).drop("_made")

    return module


def without_errors(df: DataFrame) -> DataFrame:
    """The lines that every module could read, as outputs get them."""
    return df.where(F.col(ERROR).isNull()).drop(ERROR) if ERROR in df.columns else df


class Pipeline:
    """Modules by name, in order. A module that can't be built is an error; lines that one can't read have an `error`."""

    def __init__(self) -> None:
        self._modules: list[tuple[str, Module]] = []

    @classmethod
    def from_config(cls, config: Modules) -> Pipeline:
        out = cls()
        for on, name, make in (
            (config.pattern_detection.enabled, "pattern_detection", pattern_module),
            (config.structural_parser.enabled, "structural_parser", parser_module),
            (config.performance_metrics.enabled, "performance_metrics", performance_module),
            (config.security.enabled, "security", security_module),
        ):
            if on:
                out.add(name, make(config))
        return out

    def add(self, name: str, module: Module) -> Pipeline:
        self._modules.append((name, module))
        return self

    @property
    def names(self) -> list[str]:
        return [n for n, _ in self._modules]

    def __len__(self) -> int:
        return len(self._modules)

    def run(self, raw: DataFrame) -> DataFrame:
        """The lines with every enrichment column; those of modules that are off are null, or empty where they are lists or maps."""
        df = raw
        for name, module in self._modules:
            try:
                df = module(df)
            except Exception as e:
                raise PipelineError(f"{name}: {e}") from e
        blank = {
            "level": F.lit(None).cast("string"), "error_code": F.lit(None).cast("string"), "latency_ms": F.lit(None).cast("double"),
            "security_flags": F.array().cast("array<struct<flag:string,pattern_name:string>>"), "structured": F.lit(None).cast("variant"), "tags": F.create_map().cast("map<string,string>"),
        }
        return df.withColumns({k: v for k, v in blank.items() if k not in df.columns})


class Engine:
    """A session with a configuration: `enrich` works on batches and streams alike."""

    def __init__(self, spark: SparkSession, config: Config | None = None) -> None:
        self.spark, self.config = prepare(spark), config or Config()
        self.pipeline = Pipeline.from_config(self.config.modules)

    def enrich(self, raw: DataFrame, content_col: str = "content") -> DataFrame:
        df = raw if content_col == "content" else raw.withColumnRenamed(content_col, "content")
        kept = ["received_at", "source", "content", "metadata"]
        plain = {"received_at": F.current_timestamp(), "source": F.struct(F.lit("stdin").alias("kind"), F.lit(None).cast("string").alias("addr"), F.lit(None).cast("string").alias("path")), "metadata": F.create_map().cast("map<string,string>")}
        missing = {k: v for k, v in plain.items() if k not in df.columns}
        out = self.pipeline.run(df.withColumns(missing) if missing else df)
        return out.select(*kept, *[c for c in out.columns if c not in kept])
