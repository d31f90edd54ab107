"""Raw datagrams: who sent them, when they arrived, and their bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake.functions import bytes as b

DATAGRAM_SCHEMA = "agent string, proto string, recv_ts timestamp, msg_id bigint, payload binary"

# Protocol name -> (bytes of the version field, version number).
VERSIONS = {
    "netflowv5": (2, 5),
    "netflowv9": (2, 9),
    "ipfix": (2, 10),
    "sflow": (4, 5),
}


def read_datagrams(spark: SparkSession, path: str, stream: bool = False, fmt: str = "parquet", **options) -> DataFrame:
    """A datagram table, or with ``stream=True`` a stream over its files."""
    reader = spark.readStream if stream else spark.read
    return reader.format(fmt).schema(DATAGRAM_SCHEMA).options(**options).load(path)


def read_datagram_topic(spark: SparkSession, servers: str, topic: str, proto: str, stream: bool = True, **options) -> DataFrame:
    """Datagrams from a Kafka topic: key = agent address, value = bytes.

    ``msg_id`` follows the order inside a topic partition: offsets grow by one, and the
    partition number sits above them. Needs the Kafka connector on the class path.
    """
    reader = spark.readStream if stream else spark.read
    raw = reader.format("kafka").options(**{"kafka.bootstrap.servers": servers, "subscribe": topic, **options}).load()
    return raw.select(
        F.col("key").cast("string").alias("agent"),
        F.lit(proto).alias("proto"),
        F.col("timestamp").alias("recv_ts"),
        (F.shiftleft(F.col("partition").cast("bigint"), 48) + F.col("offset")).alias("msg_id"),
        F.col("value").alias("payload"),
    )


def route_by_version(datagrams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split into (datagrams whose version field fits their protocol, rejects with a reason).

    ``proto`` says which decoder the datagram was sent to; where it is null the version
    field decides. Both outputs are narrow filters over one scan.
    """
    payload = F.col("payload")
    short, long = b.u16(payload, 0), b.u32(payload, 0)
    by_bytes = F.when(F.length(payload) < 4, F.lit(None).cast("string"))
    fits = F.lit(False)
    for proto, (width, version) in VERSIONS.items():
        word = short if width == 2 else long
        by_bytes = by_bytes.when(word == version, F.lit(proto))
        fits = fits | ((F.coalesce(F.col("proto"), F.lit(proto)) == proto) & (word == version))
    routed = datagrams.withColumn("fits", F.coalesce(fits & (F.length(payload) >= 4), F.lit(False))).withColumn(
        "proto", F.coalesce(F.col("proto"), by_bytes)
    )
    good = routed.where("fits").drop("fits")
    rejects = routed.where("not fits").select(
        "agent",
        "proto",
        "recv_ts",
        "msg_id",
        F.when(F.length(payload) < 4, F.lit("short header")).otherwise(F.lit("wrong version")).alias("reason"),
    )
    return good, rejects


def of_protocol(datagrams: DataFrame, proto: str) -> DataFrame:
    """The datagrams of one protocol; the filter on ``proto`` reaches the file scan."""
    return datagrams.where(F.col("proto") == proto)
