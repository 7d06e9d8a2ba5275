"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

# ANSI casts, UTC month buckets and adaptive plans are what the operators are written against.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


#: Tables up to this size may be shuffled to give them more tasks.
SPREAD_BYTES = 256 << 20


def build_session(app_name: str = "opinionloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's settings; cluster sizing stays with the cluster's own defaults."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder driver and executors share: ``spark.checkpoint.dir``, or in a local session the one already set.

    A local session without either gets a temporary folder of its own; a cluster session is refused, because its
    executors share no local disk.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="opinionloom-checkpoint-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and continue from the written copy."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def python_tasks(spark: SparkSession) -> SparkContext:
    """The session's context, whose Python workers find this package where the driver has it."""
    environment, home = spark.sparkContext.environment, str(Path(__file__).resolve().parents[1])
    paths = [p for p in environment.get("PYTHONPATH", "").split(":") if p]
    if home not in paths:
        environment["PYTHONPATH"] = ":".join([*paths, home])
    return spark.sparkContext


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give a scan with too few splits enough tasks for CPU-heavy text work.

    Only a small table that sits in one or two row groups is shuffled by ``key``; whatever Spark estimates at more than
    ``SPREAD_BYTES`` is returned untouched, however many cores the cluster has.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores, key) if size <= SPREAD_BYTES and df.rdd.getNumPartitions() < cores else df
