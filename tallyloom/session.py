"""A session with the settings that the jobs of this package expect."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "tallyloom", **conf: str) -> SparkSession:
    """Adaptive execution with skew handling, UTC, state by key in RocksDB, and nothing that depends on the size of the cluster."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    } | conf
    builder = SparkSession.builder.appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def cut(rows: DataFrame) -> DataFrame:
    """Materialise ``rows`` in the folder that driver and executors share, so that losing executors loses no work.

    ``spark.checkpoint.dir`` names it; only a local session without that setting gets one of its own.
    """
    _shared_folder(rows.sparkSession)
    return rows.checkpoint(eager=True)


def stored(rows: DataFrame) -> DataFrame:
    """The same as a table there, of which later steps read only the columns that they need."""
    path = f"{_shared_folder(rows.sparkSession)}/table-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _shared_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp"))
    return context.getCheckpointDir()
