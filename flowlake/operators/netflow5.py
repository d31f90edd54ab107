"""NetFlow v5: a 24-byte header and ``count`` records of 48 bytes. Narrow, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlake.functions import bytes as b

HEADER_BYTES = 24
RECORD_BYTES = 48

# Field name, offset, bytes.
HEADER_FIELDS = [
    ("Version", 0, 2),
    ("Count", 2, 2),
    ("SysUpTimeMSecs", 4, 4),
    ("UNIXSecs", 8, 4),
    ("UNIXNSecs", 12, 4),
    ("SeqNum", 16, 4),
    ("EngType", 20, 1),
    ("EngID", 21, 1),
    ("SmpInt", 22, 2),
]
RECORD_FIELDS = [
    ("SrcAddr", 0, 4),
    ("DstAddr", 4, 4),
    ("NextHop", 8, 4),
    ("Input", 12, 2),
    ("Output", 14, 2),
    ("PktCount", 16, 4),
    ("L3Octets", 20, 4),
    ("StartTime", 24, 4),
    ("EndTime", 28, 4),
    ("SrcPort", 32, 2),
    ("DstPort", 34, 2),
    ("Padding1", 36, 1),
    ("TCPFlags", 37, 1),
    ("ProtType", 38, 1),
    ("Tos", 39, 1),
    ("SrcAsNum", 40, 2),
    ("DstAsNum", 42, 2),
    ("SrcMask", 44, 1),
    ("DstMask", 45, 1),
    ("Padding2", 46, 2),
]
ADDRESS_FIELDS = {"SrcAddr", "DstAddr", "NextHop"}
_READERS = {1: b.u8, 2: b.u16, 4: b.u32}


def _read(buf: Column, name: str, offset: int, width: int) -> Column:
    if name in ADDRESS_FIELDS:
        return b.ipv4_text(buf, offset).alias(name)
    return _READERS[width](buf, offset).alias(name)


def netflow5_header(datagrams: DataFrame) -> DataFrame:
    """Header fields plus ``reason``, which is null for a packet that can be decoded."""
    payload = F.col("payload")
    fields = [_read(payload, *field) for field in HEADER_FIELDS]
    sampling = b.u16(payload, 22)
    frame = datagrams.select(
        "*",
        *fields,
        F.shiftright(sampling, 14).alias("sampling_mode"),
        sampling.bitwiseAND(F.lit(0x3FFF)).alias("sampling_interval"),
    )
    size = F.length(payload)
    reason = (
        F.when(size < HEADER_BYTES, "short header")
        .when(F.col("Version") != 5, "wrong version")
        .when(~F.col("Count").between(1, 30), "count out of bounds")
        .when(size < HEADER_BYTES + RECORD_BYTES * F.col("Count"), "short body")
    )
    return frame.withColumn("reason", reason)


def netflow5_rejects(datagrams: DataFrame) -> DataFrame:
    """One row per packet that yields no flows, with the reason."""
    return netflow5_header(datagrams).where(F.col("reason").isNotNull()).select("agent", "msg_id", "reason")


def netflow5_table(datagrams: DataFrame) -> DataFrame:
    """One row per flow: header fields, ``flow_ix``, the 20 record fields and absolute times.

    Bytes after the last counted record are ignored.
    """
    packets = netflow5_header(datagrams).where(F.col("reason").isNull())
    header = [name for name, _, _ in HEADER_FIELDS] + ["sampling_mode", "sampling_interval"]
    keep = [c for c in ("agent", "recv_ts", "msg_id") if c in datagrams.columns]
    # one slice per record, then fixed offsets inside it
    records = packets.select(
        *keep,
        *header,
        "payload",
        F.explode(F.sequence(F.lit(0), F.col("Count") - 1)).alias("flow_ix"),
    ).withColumn("record", b.cut(F.col("payload"), HEADER_BYTES + RECORD_BYTES * F.col("flow_ix"), RECORD_BYTES))
    fields = [_read(F.col("record"), *field) for field in RECORD_FIELDS]
    return netflow5_flow_times(records.select(*keep, *header, "flow_ix", *fields))


def netflow5_flow_times(flows: DataFrame) -> DataFrame:
    """Absolute start and end: export time minus uptime plus the flow's uptime stamps."""
    boot = F.col("UNIXSecs") * 1000 + F.expr("UNIXNSecs div 1000000") - F.col("SysUpTimeMSecs")
    return flows.withColumns(
        {
            "flow_start": F.timestamp_millis(boot + F.col("StartTime")),
            "flow_end": F.timestamp_millis(boot + F.col("EndTime")),
        }
    )


def netflow5_messages(datagrams: DataFrame) -> DataFrame:
    """One row per packet in message form: ``AgentID, Header, Flows``."""
    packets = netflow5_header(datagrams).where(F.col("reason").isNull())
    keep = [c for c in ("recv_ts", "msg_id") if c in datagrams.columns]

    def flow(i: Column) -> Column:
        base = F.lit(HEADER_BYTES) + F.lit(RECORD_BYTES) * i
        return F.struct(*[_read(F.col("payload"), name, base + offset, width) for name, offset, width in RECORD_FIELDS])

    flows = F.transform(F.sequence(F.lit(0), F.col("Count") - 1), flow)
    header = F.struct(*[name for name, _, _ in HEADER_FIELDS])
    return packets.select(*keep, F.col("agent").alias("AgentID"), header.alias("Header"), flows.alias("Flows"))
