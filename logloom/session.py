"""Session settings the operators rely on, set once per session and never on a machine-local path when a cluster names one."""

from __future__ import annotations

import atexit
import io
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import LogloomError

#: SQL settings that decide results: zone-free rendering, last-wins map keys, duplicate JSON keys as the last one.
RESULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Set what results depend on and ship this package to the executors; safe to call again and again."""
    for k, v in RESULT_CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    _ship(spark)
    return spark


def _ship(spark: SparkSession) -> None:
    """Send the package as a zip through Spark's file server, so that Python workers on any host can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_logloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path(root.name) / p.relative_to(root)))
    at = Path(tempfile.mkdtemp(prefix="logloom-")) / "logloom_pkg.zip"  # read by the driver only, which serves it
    at.write_bytes(buf.getvalue())
    sc.addPyFile(str(at))
    sc._logloom_shipped = True


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names. Where none is set, one of our own, which only a session whose executors all run in this
    very process can have; elsewhere a folder of this machine would lose data, so that is an error."""
    sc = spark.sparkContext
    at = sc._jsc.sc().getCheckpointDir()
    if at.isDefined():
        return at.get()
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise LogloomError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "logloom-checkpoint"))
    return sc._jsc.sc().getCheckpointDir().get()


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table in the shared folder: computed once, read by any executor, also after others are lost."""
    at = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(at)
    if not _WRITTEN:
        atexit.register(_drop_at_end, df.sparkSession)
    _WRITTEN.append(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


_WRITTEN: list[str] = []


def drop_materialised(spark: SparkSession) -> None:
    """Remove the tables `materialise` wrote in this process; results that read them are void afterwards."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(conf).delete(path, True)


def _drop_at_end(spark: SparkSession) -> None:
    """Tables of this process go with it, if its session still stands; else they stay below the checkpoint folder."""
    try:
        if spark.sparkContext._jsc is not None:
            drop_materialised(spark)
    except Exception:  # the session has ended
        _WRITTEN.clear()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the driver's tables; NTZ columns become instants in UTC."""
    prepare(spark)
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    ntz = [c for c, t in df.dtypes if t == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else df


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores, where a scan has fewer partitions than there are cores, as files of few row groups have: for what costs
    much to work out of each row. A scan of more partitions, so any large one, stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def broadcast_if_small(df: DataFrame, max_rows: int = 50_000) -> DataFrame:
    """Hint a broadcast only after the rows were counted and lie within the bound; else leave the join to Catalyst and AQE."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
