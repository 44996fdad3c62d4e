"""Session helper for tests, the bench and small local runs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
#: Fallback folders of local sessions by application, where the session sets none. Core settings cannot be set afterwards.
_LOCAL: dict[str, str] = {}


def local_session(cores: int | str = "*", memory: str = "8g", shuffle_partitions: int = 8) -> SparkSession:
    """A local session. On a cluster the session comes from the caller instead."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tallywire")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints: the cluster's own setting, or a temporary one where none is set."""
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="tallywire-ckpt-")
    return _LOCAL[app]


def kept(df: DataFrame, what: str) -> DataFrame:
    """The rows of `df` written once to a new table in the shared folder and read from there: computed once, and safe when executors are lost."""
    path = f"{checkpoint_root(df.sparkSession).rstrip('/')}/tallywire-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
