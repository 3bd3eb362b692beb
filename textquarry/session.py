"""Session settings that the package's tests and bench use, a cluster brings its own; and what operators ask of a session."""
from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(master)
        .appName("textquarry")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@cache
def _local_root() -> str:
    return "file://" + tempfile.mkdtemp(prefix="textquarry-")


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below spark.checkpoint.dir, which driver and executors share.

    Only in local mode, where both are one process, a local folder takes the place of a missing setting.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = _local_root()
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: later steps read it from there, whatever executors are lost."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of a batch of rows between the JVM and Python: what bounds a worker's memory where texts are long.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Has Spark cut Arrow batches at ``BATCH_BYTES`` too, not by 10,000 rows alone. It is a setting of the session, which a
    caller may lower further; a single row is never cut."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    set_ = spark.conf.get(name, None)
    if set_ is None or not set_.isdigit() or not 0 < int(set_) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def settled(df: DataFrame) -> DataFrame:
    """A small result that several steps read: stored where there is a shared folder, else left to be computed by each."""
    spark = df.sparkSession
    local = spark.conf.get("spark.master", "local").partition("[")[0] == "local"
    return stored(df) if local or spark.conf.get("spark.checkpoint.dir", None) else df
