"""sFlow v5: datagram header, samples, flow records, counter records. Narrow, no shuffle.

A datagram is checked as a whole before it is exploded, because one bad sample spoils all of
it: the sample lists and the record lists of whole Arrow batches are walked at once
(:mod:`flowlake.functions.sampled`), with as many steps as the datagrams themselves announce.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlake.functions import bytes as b
from flowlake.functions.columns import settle
from flowlake.functions.sampled import COUNTER_SAMPLE, EXT_ROUTER, EXT_SWITCH, FLOW_SAMPLE, RAW_HEADER, SAMPLES, Datagrams
from flowlake.operators.packet import packet_layers

# Counter kinds -> record format and its words (name, bytes).
COUNTERS = {
    "generic": (1, [
        ("Index", 4), ("Type", 4), ("Speed", 8), ("Direction", 4), ("Status", 4), ("InOctets", 8),
        ("InUnicastPackets", 4), ("InMulticastPackets", 4), ("InBroadcastPackets", 4), ("InDiscards", 4),
        ("InErrors", 4), ("InUnknownProtocols", 4), ("OutOctets", 8), ("OutUnicastPackets", 4),
        ("OutMulticastPackets", 4), ("OutBroadcastPackets", 4), ("OutDiscards", 4), ("OutErrors", 4),
        ("PromiscuousMode", 4),
    ]),
    "ethernet": (2, [
        ("AlignmentErrors", 4), ("FCSErrors", 4), ("SingleCollisionFrames", 4), ("MultipleCollisionFrames", 4),
        ("SQETestErrors", 4), ("DeferredTransmissions", 4), ("LateCollisions", 4), ("ExcessiveCollisions", 4),
        ("InternalMACTransmitErrors", 4), ("CarrierSenseErrors", 4), ("FrameTooLongs", 4),
        ("InternalMACReceiveErrors", 4), ("SymbolErrors", 4),
    ]),
    "tokenring": (3, [
        ("LineErrors", 4), ("BurstErrors", 4), ("ACErrors", 4), ("AbortTransErrors", 4), ("InternalErrors", 4),
        ("LostFrameErrors", 4), ("ReceiveCongestions", 4), ("FrameCopiedErrors", 4), ("TokenErrors", 4),
        ("SoftErrors", 4), ("HardErrors", 4), ("SignalLoss", 4), ("TransmitBeacons", 4), ("Recoverys", 4),
        ("LobeWires", 4), ("Removes", 4), ("Singles", 4), ("FreqErrors", 4),
    ]),
    "vg": (4, [
        ("InHighPriorityFrames", 4), ("InHighPriorityOctets", 8), ("InNormPriorityFrames", 4),
        ("InNormPriorityOctets", 8), ("InIPMErrors", 4), ("InOversizeFrameErrors", 4), ("InDataErrors", 4),
        ("InNullAddressedFrames", 4), ("OutHighPriorityFrames", 4), ("OutHighPriorityOctets", 8),
        ("TransitionIntoTrainings", 4), ("HCInHighPriorityOctets", 8), ("HCInNormPriorityOctets", 8),
        ("HCOutHighPriorityOctets", 8),
    ]),
    "vlan": (5, [
        ("ID", 4), ("Octets", 8), ("UnicastPackets", 4), ("MulticastPackets", 4), ("BroadcastPackets", 4),
        ("Discards", 4),
    ]),
    "processor": (1001, [("CPU5s", 4), ("CPU1m", 4), ("CPU5m", 4), ("TotalMemory", 8), ("FreeMemory", 8)]),
}
#: Bytes of the counter records by format.
COUNTER_BYTES = {number: sum(width for _, width in words) for number, words in COUNTERS.values()}

def sflow_header(datagrams: DataFrame) -> DataFrame:
    """Header fields of every version 5 datagram; ``ColTime`` is the arrival time."""
    payload = F.col("payload")
    size = F.length(payload)
    based = datagrams.where((size >= 28) & (b.u32(payload, 0) == 5)).withColumn(
        "base", F.when(b.u32(payload, 4) == 2, F.lit(24)).otherwise(F.lit(12))
    )
    base = F.col("base")
    return based.where(size >= base + 16).select(
        "*",
        b.u32(payload, 0).alias("Version"),
        b.u32(payload, 4).alias("IPVersion"),
        b.ip_text(b.cut(payload, 8, base - 8)).alias("IPAddress"),
        b.u32(payload, base).alias("AgentSubID"),
        b.u32(payload, base + 4).alias("SequenceNo"),
        b.u32(payload, base + 8).alias("SysUpTime"),
        b.u32(payload, base + 12).alias("SamplesNo"),
        F.unix_timestamp("recv_ts").alias("ColTime"),
    )


HEADER = ["Version", "IPVersion", "IPAddress", "AgentSubID", "SequenceNo", "SysUpTime", "SamplesNo", "ColTime"]


def sflow_samples(datagrams: DataFrame, exclude_types: list[int] | None = None, on_error: str = "drop_datagram") -> DataFrame:
    """One row per known sample (flow or counter) with its list of records.

    Excluded and unknown sample types are skipped unread. ``drop_datagram``: one bad sample spoils
    its datagram. ``keep_samples``: only the bad samples go.
    """
    keep = [c for c in ("agent", "recv_ts", "msg_id") if c in datagrams.columns]
    rows = checked_samples(datagrams, exclude_types, on_error)
    samples = rows.select(*keep, *HEADER, "payload", F.posexplode("samples").alias("sample_ix", "s"))
    return samples.where("s.error IS NULL").select(
        *keep, *HEADER, "payload", "sample_ix",
        F.col("s.format").alias("sample_type"), F.col("s.off").alias("off"), F.col("s.len").alias("len"),
        F.col("s.records").alias("records"),
    )


def wanted_samples(exclude_types: list[int] | None, on_error: str = "drop_datagram") -> list[int]:
    """The known sample types that are not excluded."""
    if on_error not in ("drop_datagram", "keep_samples"):
        raise ValueError(f"on_error must be 'drop_datagram' or 'keep_samples', not {on_error!r}")
    return [n for n in (FLOW_SAMPLE, COUNTER_SAMPLE) if n not in (exclude_types or [])]


def checked_samples(datagrams: DataFrame, exclude_types: list[int] | None, on_error: str) -> DataFrame:
    """Datagrams with their ``samples``, without those that a bad sample spoils."""
    wanted_samples(exclude_types, on_error)
    rows = _checked(datagrams, exclude_types)
    return rows.where("datagram_error IS NULL") if on_error == "drop_datagram" else rows


def sflow_rejects(datagrams: DataFrame, exclude_types: list[int] | None = None) -> DataFrame:
    """One row per datagram that yields nothing, with the first reason."""
    payload, size = F.col("payload"), F.length("payload")
    base = F.when(b.u32(payload, 4) == 2, F.lit(24)).otherwise(F.lit(12))
    short = (size < 28) | (size < base + 16)
    unread = datagrams.where(short | (b.u32(payload, 0) != 5)).select(
        "agent", "msg_id", F.when(short, "short header").otherwise("wrong version").alias("reason")
    )
    spoiled = _checked(datagrams, exclude_types).where("datagram_error IS NOT NULL")
    return unread.unionByName(spoiled.select("agent", "msg_id", F.col("datagram_error").alias("reason")))


def _checked(datagrams: DataFrame, exclude_types: list[int] | None) -> DataFrame:
    """Datagrams with ``samples`` (format, off, len, records, error) and ``datagram_error``."""
    wanted = wanted_samples(exclude_types)

    def read(payload: pa.Array, base: pa.Array, count: pa.Array) -> pa.Array:
        return Datagrams(payload, base, count, wanted, COUNTER_BYTES).checked()

    rows = sflow_header(datagrams)
    rows = settle(rows.withColumn("walk", F.arrow_udf(read, SAMPLES)("payload", "base", "SamplesNo")), "walk")
    return rows.select(*(c for c in rows.columns if c != "walk"), F.col("walk.samples").alias("samples"), F.col("walk.error").alias("datagram_error"))


def _record(number: int) -> Column:
    """The last record of a format; a later one replaces an earlier one."""
    return F.try_element_at(F.filter("records", lambda r: r["format"] == number), F.lit(-1))


def sflow_flow_samples(samples: DataFrame) -> DataFrame:
    """Flow samples: sequence, source, rate, pool, drops, interfaces, record count."""
    keep = [c for c in samples.columns if c not in ("sample_type", "off", "len", "SequenceNo")]
    words = [b.word(F.col("payload"), F.col("off") + 8 * i).alias(f"_w{i}") for i in range(4)]
    read = samples.where(F.col("sample_type") == FLOW_SAMPLE).select("*", *words)
    return read.select(
        *keep,
        F.col("SequenceNo").alias("datagram_seq"),
        b.bits(F.col("_w0"), 32, 32, "bigint").alias("SequenceNo"),
        b.bits(F.col("_w0"), 24, 8).alias("SourceID"),
        b.bits(F.col("_w0"), 0, 24).alias("source_index"),
        b.bits(F.col("_w1"), 32, 32, "bigint").alias("SamplingRate"),
        b.bits(F.col("_w1"), 0, 32, "bigint").alias("SamplePool"),
        b.bits(F.col("_w2"), 32, 32, "bigint").alias("Drops"),
        b.bits(F.col("_w2"), 0, 32, "bigint").alias("Input"),
        b.bits(F.col("_w3"), 32, 32, "bigint").alias("Output"),
        b.bits(F.col("_w3"), 0, 32, "bigint").alias("RecordsNo"),
    )


def switch_fields(payload: Column, at: Column) -> Column:
    names = ("SrcVlan", "SrcPriority", "DstVlan", "DstPriority")
    return F.struct(*[b.u32(payload, at + 4 * i).alias(name) for i, name in enumerate(names)])


def router_fields(payload: Column, at: Column, length: Column) -> Column:
    size = length - 12
    return F.struct(
        b.ip_text(b.cut(payload, at + 4, size)).alias("NextHop"),
        b.u32(payload, at + 4 + size).alias("SrcMask"),
        b.u32(payload, at + 8 + size).alias("DstMask"),
    )


def counter_fields(payload: Column, at: Column, kind: str) -> list[Column]:
    """The words of one counter kind."""
    fields, offset = [], 0
    for name, width in COUNTERS[kind][1]:
        read = b.u32 if width == 4 else b.u64
        fields.append(read(payload, at + offset).alias(name))
        offset += width
    return fields


def sflow_ext_switch(flow_samples: DataFrame) -> DataFrame:
    """Adds ``ext_switch``: VLAN and priority on both sides."""
    struct = switch_fields(F.col("payload"), F.col("_switch.off"))
    rows = flow_samples.withColumn("_switch", _record(EXT_SWITCH))
    return rows.withColumn("ext_switch", F.when(F.col("_switch").isNotNull(), struct)).drop("_switch")


def sflow_ext_router(flow_samples: DataFrame) -> DataFrame:
    """Adds ``ext_router``: next hop (its size is what the record leaves) and masks."""
    struct = router_fields(F.col("payload"), F.col("_router.off"), F.col("_router.len"))
    rows = flow_samples.withColumn("_router", _record(EXT_ROUTER))
    return rows.withColumn("ext_router", F.when(F.col("_router").isNotNull(), struct)).drop("_router")


def sflow_raw_header(flow_samples: DataFrame) -> DataFrame:
    """Adds ``protocol, FrameLength, Stripped, HeaderLength`` and the sampled ``header`` bytes."""
    payload, at = F.col("payload"), F.col("_raw.off")
    rows = flow_samples.withColumn("_raw", _record(RAW_HEADER))
    return rows.withColumns(
        {
            "protocol": b.u32(payload, at),
            "FrameLength": b.u32(payload, at + 4),
            "Stripped": b.u32(payload, at + 8),
            "HeaderLength": b.u32(payload, at + 12),
        }
    ).withColumn("header", b.cut(payload, at + 16, F.col("HeaderLength").cast("int"))).drop("_raw")


def sflow_packet_table(
    datagrams: DataFrame, exclude_types: list[int] | None = None, on_error: str = "drop_datagram", legacy: bool = False
) -> DataFrame:
    """One row per sampled packet: sample fields, extensions and packet layers."""
    samples = sflow_flow_samples(sflow_samples(datagrams, exclude_types, on_error))
    rows = sflow_raw_header(sflow_ext_router(sflow_ext_switch(samples)))
    return packet_layers(rows.drop("payload", "records"), legacy, checked=True).drop("packet_error")


def sflow_counter_samples(samples: DataFrame) -> DataFrame:
    """Counter samples, one row per record."""
    payload, off = F.col("payload"), F.col("off")
    keep = [c for c in samples.columns if c not in ("sample_type", "off", "len", "records", "SequenceNo")]
    return samples.where(F.col("sample_type") == COUNTER_SAMPLE).select(
        *keep,
        F.col("SequenceNo").alias("datagram_seq"),
        b.u32(payload, off).alias("SequenceNo"),
        b.u8(payload, off + 4).alias("SourceIDType"),
        b.u24(payload, off + 5).alias("SourceIDIdx"),
        b.u32(payload, off + 8).alias("RecordsNo"),
        F.posexplode("records").alias("record_ix", "record"),
    )


def sflow_counters(samples: DataFrame, kind: str) -> DataFrame:
    """One row per counter record of one kind, with the fields of that kind."""
    rows = sflow_counter_samples(samples).where(F.col("record.format") == COUNTERS[kind][0])
    fields = counter_fields(F.col("payload"), F.col("record.off"), kind)
    keep = [c for c in rows.columns if c not in ("payload", "record")]
    return rows.select(*keep, *fields)


def sflow_counter_table(datagrams: DataFrame, kind: str, exclude_types: list[int] | None = None, on_error: str = "drop_datagram") -> DataFrame:
    """Counter records of one kind straight from datagrams."""
    return sflow_counters(sflow_samples(datagrams, exclude_types, on_error), kind)
