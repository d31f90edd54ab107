"""Session settings the library relies on."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that can be changed on a running session.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # the JVM never compiles methods above 8,000 bytes; above that, operators are better generated one by one
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def configure(spark: SparkSession) -> SparkSession:
    """Pin the time zone to UTC and keep adaptive execution on."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for written tables: ``spark.checkpoint.dir``, else one below the warehouse.

    Executors on other machines do not see a machine's own folder, so without a shared one this raises.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    below = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local[") and (below.startswith("file:") or ":" not in below):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{below}/_scratch"


def stored(frame: DataFrame) -> DataFrame:
    """The frame as a table in the shared folder, so that its size is known and what it took is not done again."""
    spark = frame.sparkSession
    folder = f"{shared_folder(spark)}/flowlake-{uuid.uuid4().hex}"
    frame.write.parquet(folder)
    return spark.read.schema(frame.schema).parquet(folder)


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("flowlake")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
