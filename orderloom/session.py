"""Session helpers: settings, table access, lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings that the operators rely on; sizes follow the cluster and are not set here.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # checkpoints go when the tables that were cut there do
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cores: int | str = "*", name: str = "orderloom", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    defaults = {
        **SETTINGS,
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.maxMetadataStringLength": "1000",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a scale directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder named in spark.checkpoint.dir.

    A folder of our own is set only where the session names none (tests, local mode), so a
    cluster's shared folder is never replaced by a machine-local one.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="orderloom-"))
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, most: int) -> DataFrame:
    """Marked for broadcast if it has at most ``most`` rows, which is counted here; else joined as any other table."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Over all shuffle partitions: for steps that cost much more time than their few bytes suggest,
    which adaptive execution would otherwise put into one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder that all executors share, for tables that a query writes on its way: below the checkpoint folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="orderloom-")
    return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"
