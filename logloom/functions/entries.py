"""Small column helpers shared by the operators: the URI of a source, its kind."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def source_uri(source: Column | str = "source") -> Column:
    """`stdin`, `tcp://addr`, `udp://addr` or `file://path`; null where the source is null or names nothing."""
    s = F.col(source) if isinstance(source, str) else source
    kind = F.lower(s["kind"])
    return (
        F.when(kind == "stdin", F.lit("stdin"))
        .when(kind.isin("tcp", "udp"), F.concat(kind, F.lit("://"), s["addr"]))
        .when(kind == "file", F.concat(F.lit("file://"), s["path"]))
    )


def source_key(source: Column | str = "source") -> Column:
    """A grouping key that is never null: the URI, else whatever the struct names."""
    s = F.col(source) if isinstance(source, str) else source
    return F.coalesce(source_uri(s), F.concat_ws("|", s["kind"], s["addr"], s["path"]), F.lit(""))


def micros(ts: Column | str) -> Column:
    """Microseconds since the epoch, from an instant or an NTZ column taken as UTC."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))
