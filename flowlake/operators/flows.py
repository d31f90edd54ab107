"""Flow tables: field lists to wide rows, filters, and the top-flows report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Element ids that fill each flow column; a later field wins over an earlier one.
SOURCE_ADDRESS = (8, 27)
DESTINATION_ADDRESS = (12, 28)
NEXT_HOP = (15, 62)
SOURCE_AS = (16,)
DESTINATION_AS = (17,)
INGRESS = (10,)
EGRESS = (14,)
SOURCE_PORT = (7,)
DESTINATION_PORT = (11,)
PROTOCOL = (4,)
TCP_FLAGS = (6,)
OCTETS = (1,)

# Column name, element ids, type, default.
PROFILES = {
    "full": [
        ("sourceIPAddress", SOURCE_ADDRESS, "string", ""),
        ("destinationIPAddress", DESTINATION_ADDRESS, "string", ""),
        ("ipNextHopIPAddress", NEXT_HOP, "string", ""),
        ("bgpSourceAsNumber", SOURCE_AS, "bigint", 0),
        ("bgpDestinationAsNumber", DESTINATION_AS, "bigint", 0),
        ("ingressInterface", INGRESS, "bigint", 0),
        ("egressInterface", EGRESS, "bigint", 0),
        ("sourceTransportPort", SOURCE_PORT, "int", 0),
        ("destinationTransportPort", DESTINATION_PORT, "int", 0),
        ("protocolIdentifier", PROTOCOL, "int", 0),
        ("tcpControlBits", TCP_FLAGS, "string", ""),
        ("octetDeltaCount", OCTETS, "bigint", 0),
    ],
    "tsv": [
        ("src", SOURCE_ADDRESS, "string", "unknown"),
        ("dst", DESTINATION_ADDRESS, "string", "unknown"),
        ("nextHop", NEXT_HOP, "string", "unknown"),
        ("srcASN", SOURCE_AS, "string", "unknown"),
        ("dstASN", DESTINATION_AS, "string", "unknown"),
        ("proto", PROTOCOL, "bigint", 0),
        ("srcPort", SOURCE_PORT, "bigint", 0),
        ("dstPort", DESTINATION_PORT, "bigint", 0),
        ("tcpFlags", TCP_FLAGS, "string", "unknown"),
        ("ingressIf", INGRESS, "bigint", 0),
        ("egressIf", EGRESS, "bigint", 0),
        ("bytes", OCTETS, "bigint", 0),
    ],
    "asn": [
        ("src", SOURCE_ADDRESS, "string", ""),
        ("dst", DESTINATION_ADDRESS, "string", ""),
        ("srcASN", SOURCE_AS, "bigint", 0),
        ("dstASN", DESTINATION_AS, "bigint", 0),
        ("proto", PROTOCOL, "int", 0),
    ],
}


def _swap_interfaces(ids: tuple[int, ...]) -> tuple[int, ...]:
    return {INGRESS: EGRESS, EGRESS: INGRESS}.get(ids, ids)


def pivot_flow(records: DataFrame, profile: str = "full", legacy_interfaces: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Field lists (``fields``) to one wide flow row each; unknown ids are ignored.

    Only enterprise 0 counts, and a repeated id takes its last value. A value that does not
    fit the column's type becomes the column's default. ``legacy_interfaces`` reads element
    14 as ingress and 10 as egress. Needs ``AgentID`` and ``export_time`` beside ``fields``.

    No shuffle and no grouping: the id and value arrays are laid out once, back to front, and
    every column is an ``array_position`` into them, all in generated code; columns a later
    step does not read are pruned.
    """
    columns = PROFILES[profile]
    keep = keep or []
    lead = {
        "full": [F.col("export_time").alias("exportTime")],
        "tsv": [F.col("AgentID").alias("device")],
        "asn": [
            F.to_date("export_time").alias("date"),
            F.col("export_time").alias("time"),
            F.col("AgentID").alias("device"),
        ],
    }[profile]
    tail = [F.date_format("export_time", "yyyy-MM-dd HH:mm:ss").alias("datetime")] if profile == "tsv" else []
    plain_ids = F.col("fields.I")
    # ids of other enterprises can not match: they turn into -1
    own_ids = F.transform("fields", lambda f: F.when(F.coalesce(f["E"], F.lit(0)) == 0, f["I"]).otherwise(F.lit(-1)))
    ids = F.when(F.coalesce(F.array_max("fields.E"), F.lit(0)) == 0, plain_ids).otherwise(own_ids)
    lists = records.select(
        *keep,
        "AgentID",
        "export_time",
        F.reverse(ids).alias("_ids"),
        F.reverse("fields.V").alias("_values"),
    )
    wide = []
    for name, wanted, type_name, default in columns:
        wanted = _swap_interfaces(wanted) if legacy_interfaces else wanted
        value = _last_value(wanted)
        if type_name != "string":
            value = value.try_cast(type_name)
        wide.append(F.coalesce(value, F.lit(default).cast(type_name)).alias(name))
    return lists.select(*keep, *lead, *wide, *tail)


def _last_value(wanted: tuple[int, ...]) -> Column:
    places = [F.nullif(F.array_position("_ids", i), F.lit(0)) for i in wanted]
    place = places[0] if len(places) == 1 else F.least(*places)
    return F.get("_values", (place - 1).cast("int"))


def match_element(records: DataFrame, element_id: int = 12, value: str = "", multiplicity: bool = False) -> DataFrame:
    """Records in which some field has this id and this value (compared as text).

    With ``multiplicity`` a record comes out once per matching field.
    """
    hits = F.filter("fields", lambda f: (f["I"] == element_id) & (f["V"] == value))
    if not multiplicity:
        return records.where(F.exists("fields", lambda f: (f["I"] == element_id) & (f["V"] == value)))
    # one output row per matching field; records without a match vanish in the explode
    return records.select("*", F.explode(hits).alias("_hit")).drop("_hit")


def stop_at_element(messages: DataFrame, element_id: int = 214) -> DataFrame:
    """Keep each message's records before the first one that carries the element."""
    stops = F.transform("DataSets", lambda record: F.exists(record, lambda f: f["I"] == element_id))
    first = F.array_position(stops, True)
    kept = F.when(first > 0, F.slice("DataSets", F.lit(1), (first - 1).cast("int"))).otherwise(F.col("DataSets"))
    return messages.withColumn("DataSets", kept)


def exclude_sample_types(samples: DataFrame, types: list[int] | str, column: str = "sample_type") -> DataFrame:
    """Drop samples of the listed types (numbers, or a comma-separated text of them)."""
    if isinstance(types, str):
        types = [int(part) for part in types.split(",") if part.strip()]
    return samples.where(~F.col(column).isin(types)) if types else samples


def keep_recent(flows: DataFrame, minutes: int = 10, column: str = "export_time") -> DataFrame:
    """Flows of the last minutes before the newest one.

    The newest time is a scalar subquery over one column; its value filters the scan.
    """
    newest = flows.agg((F.max(column) - F.expr(f"INTERVAL {int(minutes)} MINUTES")).alias("since")).scalar()
    return flows.where(F.col(column) >= newest)


def top_flows(flows: DataFrame, n: int = 20, by: str = "octetDeltaCount") -> DataFrame:
    """The ``n`` largest flows. Ties break on every other column, so the report is repeatable."""
    others = [F.col(c).asc() for c in flows.columns if c != by]
    return flows.orderBy(F.col(by).desc(), *others).limit(n)


# One flow table for all protocols.
COMMON_FLOW = [
    ("protocol", "string"),
    ("agent", "string"),
    ("flow_time", "timestamp"),
    ("src", "string"),
    ("dst", "string"),
    ("next_hop", "string"),
    ("src_as", "bigint"),
    ("dst_as", "bigint"),
    ("ingress", "bigint"),
    ("egress", "bigint"),
    ("src_port", "int"),
    ("dst_port", "int"),
    ("ip_protocol", "int"),
    ("tcp_flags", "string"),
    ("packets", "bigint"),
    ("bytes", "bigint"),
    ("sampling_rate", "bigint"),
]


def _common(frame: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return frame.select(
        *[columns.get(name, F.lit(None)).cast(type_name).alias(name) for name, type_name in COMMON_FLOW]
    )


def v5_to_flow(flows: DataFrame) -> DataFrame:
    """NetFlow v5 flows in the common layout."""
    return _common(
        flows,
        {
            "protocol": F.lit("netflowv5"),
            "agent": F.col("agent"),
            "flow_time": F.col("flow_end"),
            "src": F.col("SrcAddr"),
            "dst": F.col("DstAddr"),
            "next_hop": F.col("NextHop"),
            "src_as": F.col("SrcAsNum"),
            "dst_as": F.col("DstAsNum"),
            "ingress": F.col("Input"),
            "egress": F.col("Output"),
            "src_port": F.col("SrcPort"),
            "dst_port": F.col("DstPort"),
            "ip_protocol": F.col("ProtType"),
            "tcp_flags": F.format_string("0x%02x", "TCPFlags"),
            "packets": F.col("PktCount"),
            "bytes": F.col("L3Octets"),
            "sampling_rate": F.col("sampling_interval"),
        },
    )


def ipfix_to_flow(flows: DataFrame, agent: str = "AgentID", protocol: str = "ipfix") -> DataFrame:
    """``pivot_flow(profile="full", keep=[agent])`` rows in the common layout."""
    return _common(
        flows,
        {
            "protocol": F.lit(protocol),
            "agent": F.col(agent),
            "flow_time": F.col("exportTime"),
            "src": F.col("sourceIPAddress"),
            "dst": F.col("destinationIPAddress"),
            "next_hop": F.col("ipNextHopIPAddress"),
            "src_as": F.col("bgpSourceAsNumber"),
            "dst_as": F.col("bgpDestinationAsNumber"),
            "ingress": F.col("ingressInterface"),
            "egress": F.col("egressInterface"),
            "src_port": F.col("sourceTransportPort"),
            "dst_port": F.col("destinationTransportPort"),
            "ip_protocol": F.col("protocolIdentifier"),
            "tcp_flags": F.col("tcpControlBits"),
            "bytes": F.col("octetDeltaCount"),
        },
    )


def sflow_to_flow(packets: DataFrame) -> DataFrame:
    """sFlow sampled packets in the common layout: one packet of its frame length each."""
    return _common(
        packets,
        {
            "protocol": F.lit("sflow"),
            "agent": F.col("agent"),
            "flow_time": F.col("recv_ts"),
            "src": F.coalesce("l3_v4.Src", "l3_v6.Src"),
            "dst": F.coalesce("l3_v4.Dst", "l3_v6.Dst"),
            "next_hop": F.col("ext_router.NextHop"),
            "ingress": F.col("Input"),
            "egress": F.col("Output"),
            "src_port": F.coalesce("l4_tcp.SrcPort", "l4_udp.SrcPort"),
            "dst_port": F.coalesce("l4_tcp.DstPort", "l4_udp.DstPort"),
            "ip_protocol": F.coalesce("l3_v4.Protocol", "l3_v6.NextHeader"),
            "tcp_flags": F.when(F.col("l4_tcp").isNotNull(), F.format_string("0x%02x", "l4_tcp.Flags")),
            "packets": F.lit(1),
            "bytes": F.col("FrameLength"),
            "sampling_rate": F.col("SamplingRate"),
        },
    )


def union_flows(*flows: DataFrame) -> DataFrame:
    """All protocols in one flow table."""
    result = flows[0]
    for other in flows[1:]:
        result = result.unionByName(other, allowMissingColumns=True)
    return result
