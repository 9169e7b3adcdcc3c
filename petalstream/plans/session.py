"""Sessions, and what a plan needs to know of the cluster it runs on."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC times, AQE and Arrow, which drops checkpoints that nothing refers to any more. Partition counts are left to AQE unless given."""
    b = SparkSession.builder.appName("petalstream")
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in (base | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def require(spark: SparkSession, *names: str) -> dict[str, str]:
    """The settings by name; an error that lists all that are missing or empty."""
    got = {n: spark.conf.get(n, None) or os.environ.get(n) for n in names}
    if missing := sorted(n for n, v in got.items() if not v):
        raise RuntimeError(f"not set: {', '.join(missing)}")
    return got


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder shared by all executors. Only a local session that names none (as in tests) gets one of this machine, which is removed
    with it; on a cluster that is an error, for executors could not share such a folder."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and sc.getCheckpointDir() is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="petalstream-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a reliable checkpoint in the shared folder; survives the loss of executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a compressed table in the shared folder, for what is too large to lie there uncompressed; gone with the session."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:  # the session may be gone already; the folder is the cluster's to clear then
        pass


#: Tables of up to this number of rows, each of a few hundred bytes, are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 200_000


def small(df: DataFrame) -> DataFrame:
    """The table with a hint to broadcast it, if it has at most BROADCAST_ROWS rows; else as it is. Counts rows, so it should be cut before."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
