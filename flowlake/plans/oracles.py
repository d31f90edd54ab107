"""DuckDB statements for the registered queries.

They state what each source row must turn into and never look at messages or bytes: where
Spark packs rows, walks the bytes and resolves templates, the statement reads the tables.
"""

from __future__ import annotations

# ------------------------------------------------------------------ shared parts


def _addr(prefix: str, key: str) -> str:
    return f"'{prefix}.' || ({key} // 256) % 256 || '.' || {key} % 256"


def _agent(key: str) -> str:
    return f"'10.' || ({key} // 65536) % 256 || '.' || ({key} // 256) % 256 || '.' || {key} % 256"


_HOP6 = "'2001:db8:ffff::1'"
_PROTO = "CASE l_linenumber WHEN 2 THEN 17 WHEN 3 THEN 1 WHEN 4 THEN 58 ELSE 6 END"
_OCTETS = "CAST(round(l_extendedprice * 100) AS BIGINT)"
_SRC_PORT = "1024 + l_suppkey % 60000"
_DST_PORT = "l_partkey % 65536"

#: One row per record of the JSON messages.
LINE_LEGS = f"""legs AS (
  SELECT *, {_addr('192.168', 'l_suppkey')} AS src4, {_addr('172.16', 'l_partkey')} AS dst4,
    {_addr('10.255', 'l_suppkey')} AS hop4,
    '2001:db8::' || lower(to_hex(l_suppkey + 1)) AS src6, '2001:db8:1::' || lower(to_hex(l_partkey + 1)) AS dst6,
    {_agent('o_custkey')} AS agent, epoch(o_orderdate)::BIGINT AS export_seconds,
    {_PROTO} AS proto, {_OCTETS} + leg AS octets, {_SRC_PORT} AS sp, {_DST_PORT} AS dp,
    CASE l_returnflag WHEN 'A' THEN '0x10' WHEN 'N' THEN '0x18' ELSE '0x02' END AS flags,
    CASE WHEN l_linestatus = 'F' THEN 536 ELSE 728 END AS inif, CASE WHEN l_linestatus = 'F' THEN 728 ELSE 536 END AS outif
  FROM (SELECT l.*, o_custkey, o_orderdate, unnest(range(0, 1 + l_linenumber % 3)) AS leg
        FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey))"""

#: Every field of those records, in order.
LINE_FIELDS = f"""{LINE_LEGS}, fields AS (
  SELECT legs.*, unnest(f).ix AS field_ix, unnest(f).id AS element_id, unnest(f).v AS value, unnest(f).e AS enterprise FROM (
    SELECT *, CASE leg
      WHEN 0 THEN [ROW(0, 8, src4, 0), ROW(1, 12, dst4, 0), ROW(2, 15, hop4, 0), ROW(3, 4, proto::VARCHAR, 0),
        ROW(4, 7, sp::VARCHAR, 0), ROW(5, 11, dp::VARCHAR, 0), ROW(6, 16, (64512 + l_suppkey)::VARCHAR, 0),
        ROW(7, 17, (65000 + l_partkey)::VARCHAR, 0), ROW(8, 10, inif::VARCHAR, 0), ROW(9, 14, outif::VARCHAR, 0),
        ROW(10, 1, octets::VARCHAR, 0), ROW(11, 6, flags, 0), ROW(12, 2, l_quantity::BIGINT::VARCHAR, 0),
        ROW(13, 152, epoch_ms(l_shipdate)::VARCHAR, 0)]
      WHEN 1 THEN [ROW(0, 8, dst4, 0), ROW(1, 12, src4, 0), ROW(2, 4, proto::VARCHAR, 0), ROW(3, 7, dp::VARCHAR, 0),
        ROW(4, 11, sp::VARCHAR, 0), ROW(5, 16, (65000 + l_partkey)::VARCHAR, 0), ROW(6, 17, (64512 + l_suppkey)::VARCHAR, 0),
        ROW(7, 10, outif::VARCHAR, 0), ROW(8, 14, inif::VARCHAR, 0), ROW(9, 1, octets::VARCHAR, 0),
        ROW(10, 1, (octets + 6)::VARCHAR, 29305), ROW(11, 6, flags, 0), ROW(12, 2, l_quantity::BIGINT::VARCHAR, 0),
        ROW(13, 152, epoch_ms(l_shipdate)::VARCHAR, 0), ROW(14, 214, '9', 0)][1:(CASE WHEN l_returnflag = 'R' THEN 15 ELSE 14 END)]
      ELSE [ROW(0, 4, '0', 0), ROW(1, 27, src6, 0), ROW(2, 28, dst6, 0), ROW(3, 62, {_HOP6}, 0), ROW(4, 4, proto::VARCHAR, 0),
        ROW(5, 7, sp::VARCHAR, 0), ROW(6, 11, dp::VARCHAR, 0), ROW(7, 1, octets::VARCHAR, 0), ROW(8, 6, flags, 0),
        ROW(9, 2, l_quantity::BIGINT::VARCHAR, 0), ROW(10, 152, epoch_ms(l_shipdate)::VARCHAR, 0)] END
      ::STRUCT(ix BIGINT, id BIGINT, v VARCHAR, e BIGINT)[] AS f FROM legs) AS legs)"""

_SRC = "CASE leg WHEN 0 THEN src4 WHEN 1 THEN dst4 ELSE src6 END"
_DST = "CASE leg WHEN 0 THEN dst4 WHEN 1 THEN src4 ELSE dst6 END"
_HOP = f"CASE leg WHEN 0 THEN hop4 WHEN 1 THEN '{{}}' ELSE {_HOP6} END"
_SRC_AS = "CASE leg WHEN 0 THEN 64512 + l_suppkey WHEN 1 THEN 65000 + l_partkey END"
_DST_AS = "CASE leg WHEN 0 THEN 65000 + l_partkey WHEN 1 THEN 64512 + l_suppkey END"
_IN = "CASE leg WHEN 0 THEN inif WHEN 1 THEN outif ELSE 0 END"
_OUT = "CASE leg WHEN 0 THEN outif WHEN 1 THEN inif ELSE 0 END"
_SP = "CASE WHEN leg = 1 THEN dp ELSE sp END"
_DP = "CASE WHEN leg = 1 THEN sp ELSE dp END"

FULL = f"""to_timestamp(export_seconds)::TIMESTAMP AS "exportTime", {_SRC} AS "sourceIPAddress", {_DST} AS "destinationIPAddress",
  {_HOP.format('')} AS "ipNextHopIPAddress", coalesce({_SRC_AS}, 0) AS "bgpSourceAsNumber", coalesce({_DST_AS}, 0) AS "bgpDestinationAsNumber",
  {_IN} AS "ingressInterface", {_OUT} AS "egressInterface", {_SP} AS "sourceTransportPort", {_DP} AS "destinationTransportPort",
  proto AS "protocolIdentifier", flags AS "tcpControlBits", octets AS "octetDeltaCount" """
TSV = f"""agent AS device, {_SRC} AS src, {_DST} AS dst, {_HOP.format('unknown')} AS "nextHop",
  coalesce(({_SRC_AS})::VARCHAR, 'unknown') AS "srcASN", coalesce(({_DST_AS})::VARCHAR, 'unknown') AS "dstASN", proto,
  {_SP} AS "srcPort", {_DP} AS "dstPort", flags AS "tcpFlags", {_IN} AS "ingressIf", {_OUT} AS "egressIf", octets AS bytes,
  strftime(to_timestamp(export_seconds)::TIMESTAMP, '%Y-%m-%d %H:%M:%S') AS datetime"""
ASN = f"""(to_timestamp(export_seconds)::TIMESTAMP)::DATE AS date, to_timestamp(export_seconds)::TIMESTAMP AS time, agent AS device,
  {_SRC} AS src, {_DST} AS dst, coalesce({_SRC_AS}, 0) AS "srcASN", coalesce({_DST_AS}, 0) AS "dstASN", proto"""

# ------------------------------------------------------------------ v5

V5_LEGS = f"""legs AS (
  SELECT *, {_addr('192.168', 'l_suppkey')} AS src4, {_addr('172.16', 'l_partkey')} AS dst4, {_addr('10.255', 'l_suppkey')} AS hop4,
    {_agent('l_suppkey')} AS agent, l_orderkey * 8 + l_linenumber AS msg_id, 100000000 + l_orderkey % 1000000 AS uptime,
    epoch(l_shipdate)::BIGINT AS secs, {_OCTETS} AS octets, {_SRC_PORT} AS sp, {_DST_PORT} AS dp, {_PROTO} AS proto,
    CASE l_returnflag WHEN 'A' THEN 16 WHEN 'N' THEN 24 ELSE 2 END AS flags, l_quantity::BIGINT AS packets
  FROM (SELECT *, unnest(range(0, 1 + l_linenumber % 3)) AS leg FROM lineitem))"""
_V5_HEADER = """5 AS "Version", 1 + l_linenumber % 3 AS "Count", uptime AS "SysUpTimeMSecs", secs AS "UNIXSecs",
  (l_partkey % 1000) * 1000000 AS "UNIXNSecs", l_orderkey AS "SeqNum", l_linenumber AS "EngType", l_suppkey % 256 AS "EngID",
  16384 + l_partkey % 16384 AS "SmpInt", 1 AS sampling_mode, l_partkey % 16384 AS sampling_interval"""
_V5_FLOW = """CASE WHEN leg = 1 THEN dst4 ELSE src4 END AS "SrcAddr", CASE WHEN leg = 1 THEN src4 ELSE dst4 END AS "DstAddr",
  hop4 AS "NextHop", CASE WHEN l_linestatus = 'F' THEN 536 ELSE 728 END AS "Input", CASE WHEN l_linestatus = 'F' THEN 728 ELSE 536 END AS "Output",
  packets + leg AS "PktCount", octets + leg AS "L3Octets", uptime - packets * 1000 AS "StartTime", uptime - leg AS "EndTime",
  CASE WHEN leg = 1 THEN dp ELSE sp END AS "SrcPort", CASE WHEN leg = 1 THEN sp ELSE dp END AS "DstPort", 0 AS "Padding1",
  flags AS "TCPFlags", proto AS "ProtType", l_linenumber AS "Tos",
  (CASE WHEN leg = 1 THEN 65000 + l_partkey ELSE 64512 + l_suppkey END) % 65536 AS "SrcAsNum",
  (CASE WHEN leg = 1 THEN 64512 + l_suppkey ELSE 65000 + l_partkey END) % 65536 AS "DstAsNum", 24 AS "SrcMask", 16 AS "DstMask", 0 AS "Padding2" """
_V5_START = "epoch_ms(secs * 1000 + l_partkey % 1000 - packets * 1000)::TIMESTAMP"
_V5_END = "epoch_ms(secs * 1000 + l_partkey % 1000 - leg)::TIMESTAMP"

# ------------------------------------------------------------------ templates

#: Orders with the newest announcement of their agent; a message's own one comes before its data.
TPL = f"""msgs AS (
  SELECT *, {_agent('o_custkey')} AS agent, 256 + o_custkey % 25 AS tid, CASE WHEN o_orderpriority < '4' THEN 10 ELSE 14 END AS iface,
    CAST(round(o_totalprice * 100) AS BIGINT) AS octets, o_custkey % 2 = 0 AS wide, o_custkey % 5 = 0 AS named
  FROM orders),
known AS (
  SELECT *, last_value(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END IGNORE NULLS) OVER w AS tpl_msg,
    last_value(CASE WHEN o_orderstatus = 'F' THEN iface END IGNORE NULLS) OVER w AS tpl_iface,
    last_value(CASE WHEN o_orderstatus = 'F' THEN o_orderdate END IGNORE NULLS) OVER w AS tpl_ts
  FROM msgs WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
tlegs AS (
  SELECT *, {_addr('192.168', 'o_custkey')} AS src4, {_addr('172.16', 'o_orderkey')} AS dst4, 1024 + o_custkey % 60000 AS sp, o_orderkey % 65536 AS dp
  FROM (SELECT *, unnest(range(0, 1 + o_orderkey % 3)) AS leg FROM known WHERE tpl_msg IS NOT NULL))"""
_IPFIX_FIELDS = """[ROW(0, 8, CASE WHEN leg = 1 THEN dst4 ELSE src4 END, 0), ROW(1, 12, CASE WHEN leg = 1 THEN src4 ELSE dst4 END, 0),
  ROW(2, tpl_iface, (500 + leg)::VARCHAR, 0), ROW(3, 4, (CASE leg WHEN 0 THEN 6 WHEN 1 THEN 17 ELSE 1 END)::VARCHAR, 0),
  ROW(4, 6, CASE WHEN wide THEN '16' ELSE '0x10' END, 0), ROW(5, 7, sp::VARCHAR, 0), ROW(6, 11, dp::VARCHAR, 0),
  ROW(7, 1, CASE WHEN wide THEN (octets + leg)::VARCHAR ELSE '0x' || lpad(lower(to_hex(octets + leg)), 8, '0') END, 0),
  ROW(8, 152, (epoch_ms(o_orderdate) + leg)::VARCHAR, 0), ROW(9, 82, CASE WHEN named THEN o_orderpriority ELSE left(o_orderpriority, 4) END, 0),
  ROW(10, 1, (octets + leg + 7)::VARCHAR, 29305)]::STRUCT(ix BIGINT, id BIGINT, v VARCHAR, e BIGINT)[]"""
_IPFIX_OPTION = """[ROW(0, 149, (o_custkey % 16)::VARCHAR, 0), ROW(1, 41, o_orderkey::VARCHAR, 0),
  ROW(2, 42, (1 + o_orderkey % 3)::VARCHAR, 0)]::STRUCT(ix BIGINT, id BIGINT, v VARCHAR, e BIGINT)[]"""
_V9_FIELDS = """[ROW(0, 8, CASE WHEN leg = 1 THEN dst4 ELSE src4 END, 0), ROW(1, 12, CASE WHEN leg = 1 THEN src4 ELSE dst4 END, 0),
  ROW(2, tpl_iface, (500 + leg)::VARCHAR, 0), ROW(3, 4, (CASE leg WHEN 0 THEN 6 WHEN 1 THEN 17 ELSE 1 END)::VARCHAR, 0),
  ROW(4, 6, '0x10', 0), ROW(5, 7, sp::VARCHAR, 0), ROW(6, 11, dp::VARCHAR, 0),
  ROW(7, 1, '0x' || lpad(lower(to_hex(octets + leg)), 8, '0'), 0), ROW(8, 2, (1 + o_orderkey % 3)::VARCHAR, 0), ROW(9, 21, o_orderkey::VARCHAR, 0),
  ROW(10, 56, '02:00:' || array_to_string([substr(lpad(lower(to_hex(o_custkey)), 8, '0'), i, 2) FOR i IN [1, 3, 5, 7]], ':'), 0),
  ROW(11, 27, '2001:db8::' || lower(to_hex((64512 + o_custkey % 1000 + leg) // 65536)) || ':' || lower(to_hex((64512 + o_custkey % 1000 + leg) % 65536)), 0)]
  ::STRUCT(ix BIGINT, id BIGINT, v VARCHAR, e BIGINT)[]"""
# the upper group of the last word is zero below 65536 and then belongs to the zero run
_V9_FIELDS = _V9_FIELDS.replace(
    "lower(to_hex((64512 + o_custkey % 1000 + leg) // 65536)) || ':' || ",
    "CASE WHEN 64512 + o_custkey % 1000 + leg >= 65536 THEN '1:' ELSE '' END || ",
)
_V9_OPTION = """[ROW(0, 10, o_custkey::VARCHAR, 0), ROW(1, 34, '1000', 0), ROW(2, 35, '2', 0)]
  ::STRUCT(ix BIGINT, id BIGINT, v VARCHAR, e BIGINT)[]"""


def _record_fields(fields: str, option: str) -> str:
    """Long rows of all records; the option set follows the data set."""
    return f"""WITH {TPL}, recs AS (
  SELECT agent, o_orderkey AS msg_id, CASE WHEN o_orderstatus IN ('F', 'P') THEN 1 ELSE 0 END AS set_ix, tid AS template_id, leg AS record_ix, {fields} AS f FROM tlegs
  UNION ALL SELECT agent, o_orderkey, 2, 600, 0, {option} FROM msgs WHERE o_orderstatus = 'P')
SELECT agent, msg_id, set_ix, template_id, record_ix, unnest(f).ix AS field_ix, unnest(f).id AS element_id, unnest(f).v AS value, unnest(f).e AS enterprise FROM recs"""


_DATA_BYTES = """(CASE WHEN wide THEN 10 ELSE 5 END + 33 + CASE WHEN named THEN 1 + length(o_orderpriority) ELSE 4 END) * (1 + o_orderkey % 3) + 3"""

# ------------------------------------------------------------------ sFlow

SF = f"""sf AS (
  SELECT *, l_quantity::INT AS qty, {_OCTETS} AS cents, l_linenumber % 2 = 0 AS six, l_returnflag = 'N' AS raw, l_returnflag = 'R' AS strange,
    {_PROTO} AS ip_proto, {_SRC_PORT} AS sp, {_DST_PORT} AS dp, {_agent('l_suppkey')} AS agent, l_orderkey * 8 + l_linenumber AS msg_id,
    l_quantity = 50 AND l_returnflag != 'N' AS bad
  FROM lineitem), good AS (SELECT * FROM sf WHERE NOT bad)"""
_SF_KEY = "agent, msg_id"
_SF_L3 = "CASE WHEN raw THEN 0 WHEN l_linestatus = 'F' THEN 18 ELSE 14 END"
_SF_L4_BYTES = "CASE ip_proto WHEN 6 THEN 20 ELSE 8 END"
_SF_HEADER_LEN = f"({_SF_L3} + CASE WHEN six THEN 40 ELSE 20 END + {_SF_L4_BYTES})"


def _hex_pairs(value: str) -> str:
    return f"array_to_string([substr(lpad(lower(to_hex({value})), 8, '0'), i, 2) FOR i IN [1, 3, 5, 7]], ':')"


def _six(prefix: str, key: str) -> str:
    """Text of prefix:: and a 32-bit tail."""
    return f"'{prefix}' || CASE WHEN {key} >= 65536 THEN lower(to_hex({key} // 65536)) || ':' ELSE '' END || CASE WHEN {key} = 0 THEN '' ELSE lower(to_hex({key} % 65536)) END"


def _counter_sql(kind: str) -> str:
    from flowlake.operators.sflow import COUNTERS

    number, words = COUNTERS[kind]
    place = list(COUNTERS).index(kind) + 1
    columns = ", ".join(
        f'cents + {i} AS "{name}"' if width == 4 else f'cents * 1000 + {i} AS "{name}"' for i, (name, width) in enumerate(words)
    )
    return f"""WITH {SF} SELECT {_SF_KEY}, l_orderkey AS "SequenceNo", 0 AS "SourceIDType", l_partkey AS "SourceIDIdx", 1 AS "RecordsNo",
  {columns} FROM good WHERE l_linenumber % 6 = {place % 6}"""


_KINDS = {"generic": "GenInt", "ethernet": "EthInt", "tokenring": "TRInt", "vg": "VGInt", "vlan": "Vlan", "processor": "Proc"}


def _counter_words_sql(place: int, kind: str) -> str:
    """Every word of one counter kind as a row."""
    from flowlake.operators.sflow import COUNTERS

    words = ", ".join(
        f"ROW('{name}', cents {'' if width == 4 else '* 1000 '}+ {i})" for i, (name, width) in enumerate(COUNTERS[kind][1])
    )
    return f"""SELECT {_SF_KEY}, source_index, tag, unnest(w).word AS word, unnest(w).n AS n FROM (SELECT {_SF_KEY}, l_partkey AS source_index,
  '{_KINDS[kind]}' AS tag, [{words}]::STRUCT(word VARCHAR, n BIGINT)[] AS w FROM good WHERE l_linenumber % 6 = {place % 6})"""


# ------------------------------------------------------------------ collector statistics

_EV = """ev AS (SELECT 'host' || user_id % 8 AS host, CASE event_type WHEN 'view' THEN 'sflow' WHEN 'purchase' THEN 'netflowv5'
    WHEN 'signup' THEN 'netflowv9' ELSE 'ipfix' END AS proto, ts, user_id % 16 AS part, value >= 5 AS decoded, event_type = 'error' AS err,
    floor(value)::BIGINT AS size FROM events)"""
STATS = f"""{_EV}, hourly AS (
  SELECT host, proto, date_trunc('hour', ts) AS ts, count(*) AS n, count(*) FILTER (decoded) AS d, count(*) FILTER (err) AS e, sum(size)::BIGINT AS s
  FROM ev GROUP BY ALL),
stats AS (
  SELECT host, proto, ts, epoch(date_trunc('week', ts))::BIGINT AS start_time, sum(n) OVER w AS udp_count, sum(d) OVER w AS decoded_count,
    sum(e) OVER w AS mq_error_count, n AS udp_queue, s % 1000 AS message_queue, n % 16 + 1 AS workers,
    CASE WHEN proto = 'ipfix' THEN s % 7 END AS udp_mirror_queue
  FROM hourly WINDOW w AS (PARTITION BY host, proto, date_trunc('week', ts) ORDER BY ts)),
gains AS (
  SELECT *, epoch(ts)::BIGINT - lag(epoch(ts)::BIGINT) OVER w AS gap, udp_count - lag(udp_count) OVER w AS gu,
    decoded_count - lag(decoded_count) OVER w AS gd, mq_error_count - lag(mq_error_count) OVER w AS ge
  FROM stats WINDOW w AS (PARTITION BY host, proto, start_time ORDER BY ts)),
rates AS (
  SELECT host, proto, ts, start_time, udp_count::BIGINT AS udp_count, decoded_count::BIGINT AS decoded_count, mq_error_count::BIGINT AS mq_error_count,
    udp_queue, message_queue, workers, udp_mirror_queue, (gu // gap)::BIGINT AS udp_rate, (gd // gap)::BIGINT AS decode_rate, (ge // gap)::BIGINT AS mq_error_rate
  FROM gains),
long AS (
  SELECT host, proto AS type, ts, unnest(m).k AS metric, unnest(m).v AS value FROM (SELECT *, [ROW('udp.rate', udp_rate), ROW('decode.rate', decode_rate),
    ROW('mq.error.rate', mq_error_rate), ROW('workers', workers), ROW('udp.queue', udp_queue), ROW('mq.queue', message_queue),
    ROW('udp.mirror.queue', udp_mirror_queue)]::STRUCT(k VARCHAR, v BIGINT)[] AS m FROM rates) WHERE true),
latest AS (SELECT * FROM rates QUALIFY row_number() OVER (PARTITION BY host, proto ORDER BY ts DESC) = 1)"""
_SECOND = "time_bucket(INTERVAL '10 seconds', ts)"


def statements() -> dict[str, str]:
    sql: dict[str, str] = {}
    full = f"WITH {LINE_LEGS} SELECT {FULL} FROM legs"
    sql["top_flows"] = full + """ ORDER BY "octetDeltaCount" DESC, "exportTime", "sourceIPAddress", "destinationIPAddress", "ipNextHopIPAddress",
  "bgpSourceAsNumber", "bgpDestinationAsNumber", "ingressInterface", "egressInterface", "sourceTransportPort", "destinationTransportPort",
  "protocolIdentifier", "tcpControlBits" LIMIT 20"""
    sql["pivot_flow_full"] = full
    sql["pivot_flow_legacy"] = (
        f'SELECT * EXCLUDE (a, b), a AS "egressInterface", b AS "ingressInterface" FROM '
        f'(SELECT * EXCLUDE ("ingressInterface", "egressInterface"), "ingressInterface" AS a, "egressInterface" AS b FROM ({full}))'
    )
    sql["pivot_flow_tsv"] = sql["write_tsv"] = f"WITH {LINE_LEGS} SELECT {TSV} FROM legs"
    sql["pivot_flow_asn"] = sql["append_flows_by_date"] = f"WITH {LINE_LEGS} SELECT {ASN} FROM legs"
    sql["append_flows"] = sql["stream_ingest"] = sql["append_once"] = full
    sql["parse_messages"] = sql["read_messages"] = f"""SELECT {_agent('o_custkey')} AS agent, 10 AS version, l_orderkey AS seq, o_custkey % 16 AS domain,
  epoch(o_orderdate)::BIGINT AS export_seconds, 1 + l_linenumber % 3 AS records FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""
    sql["explode_records"] = f"""WITH {LINE_FIELDS} SELECT agent, l_orderkey AS seq, leg AS record_ix, count(*) AS fields,
  max(CASE WHEN element_id = 1 AND enterprise = 0 THEN value END) AS octets FROM fields
  GROUP BY agent, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, leg"""
    sql["explode_fields"] = f"WITH {LINE_FIELDS} SELECT agent, l_orderkey AS seq, leg AS record_ix, field_ix, element_id, value, enterprise FROM fields"
    sql["encode_message"] = sql["explode_fields"]
    sql["encode_message_flat"] = f"""WITH {LINE_FIELDS} SELECT agent, l_orderkey AS seq, leg AS record_ix, element_id, value FROM fields
  QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, leg, element_id ORDER BY field_ix DESC) = 1"""
    sql["export_timestamp"] = f"""SELECT l_orderkey AS seq, o_orderdate AS export_time FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""
    names = "SELECT * FROM (VALUES (0, 8, 'sourceIPv4Address'), (0, 12, 'destinationIPv4Address'), (0, 15, 'ipNextHopIPv4Address'), (0, 4, 'protocolIdentifier'), (0, 7, 'sourceTransportPort'), (0, 11, 'destinationTransportPort'), (0, 16, 'bgpSourceAsNumber'), (0, 17, 'bgpDestinationAsNumber'), (0, 10, 'ingressInterface'), (0, 14, 'egressInterface'), (0, 1, 'octetDeltaCount'), (0, 6, 'tcpControlBits'), (0, 2, 'packetDeltaCount'), (0, 152, 'flowStartMilliseconds'), (0, 27, 'sourceIPv6Address'), (0, 28, 'destinationIPv6Address'), (0, 62, 'ipNextHopIPv6Address'), (0, 214, 'exportProtocolVersion')) n(e, id, name)"
    sql["name_elements"] = f"""WITH {LINE_FIELDS}, names AS ({names}) SELECT enterprise, element_id, name, count(*) AS n
  FROM fields LEFT JOIN names ON id = element_id AND e = enterprise GROUP BY ALL"""
    sql["unknown_elements"] = f"WITH {LINE_FIELDS} SELECT enterprise, element_id, count(*) AS n FROM fields WHERE enterprise != 0 GROUP BY ALL"
    match = f"""WITH {LINE_FIELDS} SELECT agent, l_orderkey AS seq, leg AS record_ix FROM fields WHERE element_id = 12 AND value = '172.16.0.7'"""
    sql["match_element"] = sql["stream_match_element"] = match
    sql["match_element_numeric"] = f"""WITH {LINE_FIELDS} SELECT agent, l_orderkey AS seq, leg AS record_ix FROM fields WHERE element_id = 4 AND value = '6'"""
    sql["stop_at_element"] = f"""SELECT {_agent('o_custkey')} AS agent, l_orderkey AS seq, leg AS record_ix, {_OCTETS} + leg AS octets
  FROM (SELECT lineitem.*, unnest(range(0, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 1 + l_linenumber % 3 END)) AS leg FROM lineitem)
  JOIN orders ON l_orderkey = o_orderkey"""
    sql["drop_empty"] = f"""SELECT {_agent('o_custkey')} AS agent, l_orderkey AS seq, 1 + l_linenumber % 3 - CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS records
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE 1 + l_linenumber % 3 - CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END > 0"""
    sql["keep_recent"] = full.replace("FROM legs", "FROM legs WHERE export_seconds >= (SELECT max(export_seconds) - 60 * 1440 FROM legs)")

    # v5
    sql["netflow5_header"] = f"WITH {V5_LEGS} SELECT agent, msg_id, {_V5_HEADER} FROM legs WHERE leg = 0"
    sql["netflow5_flows"] = f"WITH {V5_LEGS} SELECT agent, msg_id, leg AS flow_ix, {_V5_FLOW} FROM legs"
    sql["netflow5_messages"] = sql["netflow5_flows"].replace("leg AS flow_ix", '"SeqNum", leg AS flow_ix').replace('"SeqNum"', 'l_orderkey AS "SeqNum"')
    sql["netflow5_flow_times"] = f"WITH {V5_LEGS} SELECT msg_id, leg AS flow_ix, {_V5_START} AS flow_start, {_V5_END} AS flow_end FROM legs"
    sql["read_datagrams"] = f"SELECT {_agent('l_suppkey')} AS agent, l_orderkey * 8 + l_linenumber AS msg_id, 24 + 48 * (1 + l_linenumber % 3) AS bytes FROM lineitem"
    v5_common = f"""SELECT 'netflowv5' AS protocol, agent, {_V5_END} AS flow_time, CASE WHEN leg = 1 THEN dst4 ELSE src4 END AS src,
  CASE WHEN leg = 1 THEN src4 ELSE dst4 END AS dst, octets + leg AS bytes, '0x' || lpad(lower(to_hex(flags)), 2, '0') AS tcp_flags FROM v5"""
    line_common = f"""SELECT 'ipfix', agent, to_timestamp(export_seconds)::TIMESTAMP, {_SRC}, {_DST}, octets, flags FROM legs"""
    sf_common = f"""SELECT 'sflow', agent, l_shipdate, CASE WHEN six THEN {_six('2001:db8::', '(l_suppkey + 1)')} ELSE {_addr('192.168', 'l_suppkey')} END,
  CASE WHEN six THEN {_six('2001:db8:1::', '(l_partkey + 1)')} ELSE {_addr('172.16', 'l_partkey')} END, qty * 20 + 64,
  CASE WHEN ip_proto = 6 THEN '0x' || lower(to_hex(256 + l_linenumber)) END FROM good"""
    sql["union_flows"] = f"WITH {V5_LEGS.replace('legs AS', 'v5 AS', 1)}, {LINE_LEGS}, {SF} {v5_common} UNION ALL {line_common} UNION ALL {sf_common}"

    # routing
    sql["route_by_version"] = """SELECT proto, reason, count(*) AS n FROM (
  SELECT 'netflowv5' AS proto, NULL AS reason FROM lineitem UNION ALL SELECT 'sflow', NULL FROM lineitem UNION ALL SELECT 'ipfix', NULL FROM orders
  UNION ALL SELECT 'ipfix', 'wrong version' FROM orders) GROUP BY ALL"""

    # IPFIX
    sql["ipfix_header"] = f"""WITH {TPL} SELECT agent, o_orderkey AS msg_id, 10 AS "Version",
  16 + 4 + {_DATA_BYTES} + CASE o_orderstatus WHEN 'F' THEN 56 WHEN 'P' THEN 24 + 24 ELSE 0 END AS "Length", epoch(o_orderdate)::BIGINT AS "ExportTime",
  o_orderkey AS "SequenceNo", o_custkey % 16 AS "DomainID" FROM msgs"""
    sets = f"""SELECT o_orderkey AS msg_id, 0 AS set_ix, CASE o_orderstatus WHEN 'F' THEN {{0}} ELSE {{1}} END AS set_id, CASE o_orderstatus WHEN 'F' THEN {{2}} ELSE {{3}} END AS bytes
  FROM msgs WHERE o_orderstatus IN ('F', 'P')
  UNION ALL SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'P') THEN 1 ELSE 0 END, tid, {{4}} FROM msgs
  UNION ALL SELECT o_orderkey, 2, 600, {{5}} FROM msgs WHERE o_orderstatus = 'P'"""
    sql["ipfix_sets"] = f"WITH {TPL} " + sets.format(2, 3, 52, 20, _DATA_BYTES, 20)
    sql["netflow9_sets"] = f"WITH {TPL} " + sets.format(0, 1, 52, 18, "56 * (1 + o_orderkey % 3)", 9)
    template = """[ROW(0, 8, 4, 0), ROW(1, 12, 4, 0), ROW(2, iface, 4, 0), ROW(3, 4, 1, 0), ROW(4, 6, CASE WHEN wide THEN 2 ELSE 1 END, 0), ROW(5, 7, 2, 0),
  ROW(6, 11, 2, 0), ROW(7, 1, CASE WHEN wide THEN 8 ELSE 4 END, 0), ROW(8, 152, 8, 0), ROW(9, 82, CASE WHEN named THEN 65535 ELSE 4 END, 0),
  ROW(10, 1, 8, 29305)]::STRUCT(ix BIGINT, id BIGINT, n BIGINT, e BIGINT)[]"""
    option = "[ROW(0, 149, 4, 0), ROW(1, 41, 8, 0), ROW(2, 42, 8, 0)]::STRUCT(ix BIGINT, id BIGINT, n BIGINT, e BIGINT)[]"
    fields = "unnest(f).ix AS field_ix, unnest(f).id AS element_id, unnest(f).n AS length, unnest(f).e AS enterprise"
    sql["template_records"] = f"""WITH {TPL}, t AS (SELECT agent, o_orderkey AS msg_id, tid AS template_id, {template} AS f FROM msgs WHERE o_orderstatus = 'F'
  UNION ALL SELECT agent, o_orderkey, 600, {option} FROM msgs WHERE o_orderstatus = 'P') SELECT agent, msg_id, template_id, {fields} FROM t"""
    sql["option_template_records"] = f"""WITH {TPL} SELECT agent, o_orderkey AS msg_id, 600 AS template_id, 1 AS scope_count, 3 AS fields FROM msgs WHERE o_orderstatus = 'P'"""
    latest = """SELECT agent, tid AS template_id, o_orderkey AS msg_id, o_orderdate AS recv_ts, 11 AS fields FROM msgs WHERE o_orderstatus = 'F'
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1
  UNION ALL SELECT agent, 600, o_orderkey, o_orderdate, 3 FROM msgs WHERE o_orderstatus = 'P'
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"""
    sql["template_registry"] = sql["save_load_templates"] = f"WITH {TPL} SELECT * FROM ({latest})"
    sql["known_template_ids"] = f"WITH {TPL} SELECT template_id FROM ({latest})"
    resolved = f"""SELECT agent, o_orderkey AS msg_id, tid AS template_id, tpl_iface AS interface_element FROM known
  UNION ALL SELECT agent, o_orderkey, 600, NULL FROM msgs WHERE o_orderstatus = 'P'"""
    sql["resolve_templates"] = sql["stream_resolve_templates"] = f"WITH {TPL} {resolved}"
    sql["ipfix_records"] = _record_fields(_IPFIX_FIELDS, _IPFIX_OPTION)
    sql["ipfix_records_keep_sets"] = sql["ipfix_records"]
    sql["ipfix_messages"] = f"SELECT agent, msg_id, element_id, value, enterprise, count(*) AS n FROM ({sql['ipfix_records']}) GROUP BY ALL"
    sql["ipfix_flow_table"] = f"""WITH {TPL} SELECT agent, o_orderkey AS msg_id, o_orderdate AS "exportTime", CASE WHEN leg = 1 THEN dst4 ELSE src4 END AS "sourceIPAddress",
  CASE WHEN leg = 1 THEN src4 ELSE dst4 END AS "destinationIPAddress", '' AS "ipNextHopIPAddress", 0 AS "bgpSourceAsNumber", 0 AS "bgpDestinationAsNumber",
  CASE WHEN tpl_iface = 10 THEN 500 + leg ELSE 0 END AS "ingressInterface", CASE WHEN tpl_iface = 14 THEN 500 + leg ELSE 0 END AS "egressInterface",
  sp AS "sourceTransportPort", dp AS "destinationTransportPort", CASE leg WHEN 0 THEN 6 WHEN 1 THEN 17 ELSE 1 END AS "protocolIdentifier",
  CASE WHEN wide THEN '16' ELSE '0x10' END AS "tcpControlBits", CASE WHEN wide THEN octets + leg ELSE 0 END AS "octetDeltaCount" FROM tlegs"""
    sql["ipfix_flow_table_widened"] = sql["ipfix_flow_table"].replace("CASE WHEN wide THEN '16' ELSE '0x10' END", "'16'").replace(
        "CASE WHEN wide THEN octets + leg ELSE 0 END", "octets + leg"
    )
    sql["netflow9_records"] = _record_fields(_V9_FIELDS, _V9_OPTION)
    sql["netflow9_messages"] = f"SELECT agent, msg_id, element_id, value, enterprise, count(*) AS n FROM ({sql['netflow9_records']}) GROUP BY ALL"
    # the IPv6 source comes after the IPv4 one and counts
    six = _six("2001:db8::", "(64512 + o_custkey % 1000 + leg)")
    sql["netflow9_flow_table"] = sql["ipfix_flow_table_widened"].replace('CASE WHEN leg = 1 THEN dst4 ELSE src4 END AS "sourceIPAddress"', f'{six} AS "sourceIPAddress"')
    sql["union_flows"] += f""" UNION ALL SELECT 'netflowv9', agent, "exportTime", "sourceIPAddress", "destinationIPAddress", "octetDeltaCount", "tcpControlBits"
  FROM ({sql['netflow9_flow_table']})"""
    sql["netflow9_header"] = f"""WITH {TPL} SELECT agent, o_orderkey AS msg_id, 9 AS "Version", 1 + o_orderkey % 3 AS "Count", 357280 AS "SysUpTime",
  epoch(o_orderdate)::BIGINT AS "UNIXSecs", o_orderkey AS "SeqNum", o_custkey % 16 AS "SrcID" FROM msgs"""
    sql["unresolved_report"] = sql["netflow9_report"] = f"WITH {TPL} SELECT agent, tid AS set_id, 'unknown template' AS reason, count(*) AS n FROM known WHERE tpl_msg IS NULL GROUP BY ALL"
    # of damaged messages, those divisible by 7 have a template that is cut short, those that leave 1 a data set that does not end on a record
    sql["damaged_ipfix_records_keep_sets"] = f"SELECT * FROM ({sql['ipfix_records']}) WHERE msg_id % 7 != 0"
    sql["damaged_ipfix_records"] = f"""WITH {TPL} SELECT r.* FROM ({sql['ipfix_records']}) r JOIN known ON msg_id = o_orderkey
  WHERE msg_id % 7 != 0 AND NOT (msg_id % 7 = 1 AND tpl_msg IS NOT NULL)"""
    all_sets = "SELECT *, tid AS set_id FROM known UNION ALL SELECT *, 600 FROM known WHERE o_orderstatus = 'P'"
    losses = f"""SELECT agent, NULL AS set_id, 'template cut short' AS reason FROM known WHERE o_orderkey % 7 = 0
  UNION ALL SELECT agent, set_id, 'template cut short' FROM ({all_sets}) WHERE o_orderkey % 7 = 0
  UNION ALL SELECT agent, tid, 'unknown template' FROM known WHERE tpl_msg IS NULL AND o_orderkey % 7 != 0
  UNION ALL SELECT agent, tid, CASE WHEN tpl_msg IS NULL THEN 'unknown template' ELSE 'set does not end on a record' END FROM known WHERE o_orderkey % 7 = 1"""
    fallen = f"SELECT agent, set_id, 'message dropped' FROM ({all_sets}) WHERE o_orderkey % 7 = 1 AND tpl_msg IS NOT NULL"
    sql["damaged_netflow9_report"] = f"WITH {TPL} SELECT agent, set_id, reason, count(*) AS n FROM ({losses}) GROUP BY ALL"
    sql["damaged_ipfix_report"] = f"WITH {TPL} SELECT agent, set_id, reason, count(*) AS n FROM ({losses} UNION ALL {fallen}) GROUP BY ALL"
    first = """SELECT o_custkey, o_orderdate AS came, iface FROM msgs WHERE o_orderstatus = 'F'
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1"""
    in_time = "came IS NOT NULL AND came <= k.o_orderdate + INTERVAL 365 DAY"
    replayed = f"""SELECT agent, o_orderkey AS msg_id, tid AS template_id, CASE WHEN {in_time} THEN f.iface END AS interface_element,
  CASE WHEN {in_time} THEN 1 + o_orderkey % 3 ELSE 0 END AS records, CASE WHEN {in_time} THEN 'resolved'
    WHEN k.o_orderdate + INTERVAL 365 DAY < (SELECT max(o_orderdate) FROM msgs) THEN 'template never came' ELSE 'waiting' END AS verdict
  FROM known k LEFT JOIN ({first}) f USING (o_custkey) WHERE tpl_msg IS NULL"""
    sql["replay_unresolved"] = f"WITH {TPL} {replayed}"
    sql["stream_replay"] = f"WITH {TPL} SELECT * EXCLUDE (verdict) FROM ({replayed}) WHERE verdict = 'resolved'"
    sql["stream_ipfix_records"], sql["stream_netflow9_records"] = sql["ipfix_records"], sql["netflow9_records"]
    sql["stream_netflow5_flows"] = sql["netflow5_flows"]
    sql["interpret_value"] = f"""WITH r AS (SELECT o_orderkey AS key, CAST(round(o_totalprice * 100) AS BIGINT) * 1000003 AS v FROM orders), h AS (SELECT *, lpad(lower(to_hex(v)), 16, '0') AS x FROM r)
  SELECT key, unnest(['unsigned64', 'unsigned32', 'unsigned16', 'unsigned8', 'signed64', 'octetArray', 'macAddress', 'boolean', 'ipv4Address', 'ipv6Address', 'dateTimeSeconds',
    'dateTimeMilliseconds', 'dateTimeMicroseconds', 'dateTimeNanoseconds', 'signed8', 'signed16', 'signed32']) AS type,
    unnest([v::VARCHAR, (v >> 32)::VARCHAR, (v >> 48)::VARCHAR, (v >> 56)::VARCHAR, v::VARCHAR, '0x' || x,
      array_to_string([substr(x, i, 2) FOR i IN [1, 3, 5, 7, 9, 11, 13, 15]], ':'), CASE WHEN v >> 56 = 1 THEN 'true' ELSE 'false' END, '?' || x, '0x' || x, (v >> 32)::VARCHAR,
      v::VARCHAR, v::VARCHAR, v::VARCHAR, (v >> 56)::TINYINT::VARCHAR, (CASE WHEN v >> 48 >= 32768 THEN (v >> 48) - 65536 ELSE v >> 48 END)::VARCHAR, (v >> 32)::VARCHAR]) AS value FROM h"""
    sql["text_helpers"] = f"""SELECT o_orderkey AS key, '172.16.' || (o_orderkey // 256) % 256 || '.' || o_orderkey % 256 AS ipv4,
  {_six('2001:db8::', 'o_orderkey')} AS ipv6, '02:00:' || {_hex_pairs('o_orderkey')} AS mac, '0x' || lpad(lower(to_hex(o_orderkey)), 8, '0') AS hex FROM orders"""

    # sFlow
    agent6 = _six("2001:db8::", "l_suppkey")
    sql["sflow_header"] = f"""WITH {SF} SELECT agent, msg_id, 5 AS "Version", CASE WHEN l_linestatus = 'O' THEN 2 ELSE 1 END AS "IPVersion",
  CASE WHEN l_linestatus = 'O' THEN {agent6} ELSE agent END AS "IPAddress", 7 AS "AgentSubID", l_orderkey AS "SequenceNo",
  3600000 AS "SysUpTime", CASE WHEN strange THEN 3 ELSE 2 END AS "SamplesNo", epoch(l_shipdate)::BIGINT AS "ColTime" FROM sf"""
    counter_bytes = "CASE l_linenumber % 6 WHEN 1 THEN 88 WHEN 2 THEN 52 WHEN 3 THEN 72 WHEN 4 THEN 80 WHEN 5 THEN 28 ELSE 28 END"
    flow_bytes = f"32 + 3 * 8 + 32 + 16 + (({_SF_HEADER_LEN} + 3) // 4) * 4"
    sql["sflow_samples"] = f"""WITH {SF} SELECT {_SF_KEY}, 1 AS sample_type, {flow_bytes} AS bytes, 3 AS records FROM good
  UNION ALL SELECT {_SF_KEY}, 2, 12 + 8 + {counter_bytes}, 1 FROM good"""
    sql["exclude_sample_types"] = f"WITH {SF} SELECT {_SF_KEY}, 2 AS sample_type FROM sf"
    sql["sflow_keep_samples"] = f"WITH {SF} SELECT {_SF_KEY}, 1 AS sample_type FROM good UNION ALL SELECT {_SF_KEY}, 2 FROM sf"
    sql["sflow_rejects"] = f"WITH {SF} SELECT agent, msg_id, 'unknown ether type' AS reason FROM sf WHERE bad"
    sql["sflow_flow_samples"] = f"""WITH {SF} SELECT {_SF_KEY}, l_orderkey AS "SequenceNo", 1 AS "SourceID", l_suppkey AS source_index, 4096 AS "SamplingRate", cents AS "SamplePool",
  qty AS "Drops", 536 AS "Input", 728 AS "Output", 3 AS "RecordsNo" FROM good"""
    sql["sflow_raw_header"] = f"""WITH {SF} SELECT {_SF_KEY}, CASE WHEN NOT raw THEN 1 WHEN six THEN 12 ELSE 11 END AS protocol, qty * 20 + 64 AS "FrameLength", 4 AS "Stripped",
  {_SF_HEADER_LEN} AS "HeaderLength" FROM good"""
    sql["sflow_ext_switch"] = f"""WITH {SF} SELECT {_SF_KEY}, qty AS "SrcVlan", 1 AS "SrcPriority", qty + 1 AS "DstVlan", 2 AS "DstPriority" FROM good"""
    sql["sflow_ext_router"] = f"""WITH {SF} SELECT {_SF_KEY}, {_addr('10.255', 'l_suppkey')} AS "NextHop", 24 AS "SrcMask", 16 AS "DstMask" FROM good"""
    sql["sflow_counter_samples"] = f"""WITH {SF} SELECT {_SF_KEY}, l_orderkey AS "SequenceNo", 0 AS "SourceIDType", l_partkey AS "SourceIDIdx", 1 AS "RecordsNo",
  CASE l_linenumber % 6 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 4 WHEN 5 THEN 5 ELSE 1001 END AS format FROM good"""
    for kind in ("generic", "ethernet", "tokenring", "vg", "vlan", "processor"):
        sql[f"sflow_counters_{kind}"] = _counter_sql(kind)
    sql["ethernet_layer"] = f"""WITH {SF} SELECT {_SF_KEY}, '02:02:' || {_hex_pairs('l_suppkey')} AS "SrcMAC", '02:01:' || {_hex_pairs('l_partkey')} AS "DstMAC",
  CASE WHEN l_linestatus = 'F' THEN 8192 + qty ELSE 0 END AS "Vlan", CASE WHEN l_linestatus = 'F' THEN qty ELSE 0 END AS vlan_id,
  CASE WHEN six THEN 34525 ELSE 2048 END AS "EtherType" FROM good WHERE NOT raw"""
    sql["ipv4_layer"] = f"""WITH {SF} SELECT {_SF_KEY}, 4 AS "Version", 16 AS "TOS", qty + 40 AS "TotalLen", l_orderkey % 65536 AS "ID", 2 AS "Flags", 0 AS "FragOff", 62 AS "TTL",
  ip_proto AS "Protocol", l_partkey % 65536 AS "Checksum", {_addr('192.168', 'l_suppkey')} AS "Src", {_addr('172.16', 'l_partkey')} AS "Dst" FROM good WHERE NOT six"""
    sql["ipv6_layer"] = f"""WITH {SF} SELECT {_SF_KEY}, 6 AS "Version", 18 AS "TrafficClass", 214375 AS "FlowLabel", qty + 40 AS "PayloadLen", ip_proto AS "NextHeader", 64 AS "HopLimit",
  {_six('2001:db8::', '(l_suppkey + 1)')} AS "Src", {_six('2001:db8:1::', '(l_partkey + 1)')} AS "Dst" FROM good WHERE six"""
    sql["tcp_layer"] = f"""WITH {SF} SELECT {_SF_KEY}, sp AS "SrcPort", dp AS "DstPort", 5 AS "DataOffset", 0 AS "Reserved", 256 + l_linenumber AS "Flags" FROM good WHERE ip_proto = 6"""
    sql["udp_layer"] = f"""WITH {SF} SELECT {_SF_KEY}, sp AS "SrcPort", dp AS "DstPort" FROM good WHERE ip_proto = 17"""
    sql["icmp_layer"] = f"""WITH {SF} SELECT {_SF_KEY}, 8 AS "Type", qty AS "Code", '0x' || lpad(lower(to_hex(l_partkey)), 8, '0') AS "RestHeader" FROM good WHERE ip_proto IN (1, 58)"""
    six_or_four = lambda prefix6, prefix4, key: f"CASE WHEN six THEN {_six(prefix6, f'({key} + 1)')} ELSE {_addr(prefix4, key)} END"
    sql["sflow_messages"] = f"""WITH {SF} SELECT {_SF_KEY}, l_shipdate::TIMESTAMP AS export_time, CASE WHEN l_linestatus = 'O' THEN {agent6} ELSE agent END AS "IPAddress",
  CASE WHEN strange THEN 3 ELSE 2 END AS "SamplesNo", 1 AS counters, l_orderkey AS "SequenceNo", 1 AS "SourceID", 4096 AS "SamplingRate", cents AS "SamplePool",
  qty AS "Drops", 536 AS "Input", 728 AS "Output", 3 AS "RecordsNo", CASE WHEN raw THEN '' ELSE '02:02:' || {_hex_pairs('l_suppkey')} END AS "SrcMAC",
  CASE WHEN NOT raw AND l_linestatus = 'F' THEN 8192 + qty ELSE 0 END AS "Vlan", CASE WHEN six THEN 6 ELSE 4 END AS "IPv",
  {six_or_four('2001:db8::', '192.168', 'l_suppkey')} AS "Src", {six_or_four('2001:db8:1::', '172.16', 'l_partkey')} AS "Dst",
  CASE WHEN NOT six THEN qty + 40 END AS "TotalLen", CASE WHEN six THEN qty + 40 END AS "PayloadLen", ip_proto AS ip_protocol,
  CASE WHEN ip_proto IN (6, 17) THEN sp END AS "SrcPort", CASE WHEN ip_proto IN (6, 17) THEN dp END AS "DstPort", CASE ip_proto WHEN 6 THEN 256 + l_linenumber END AS "Flags",
  CASE WHEN ip_proto IN (1, 58) THEN qty END AS "Code", CASE WHEN ip_proto IN (1, 58) THEN '0x' || lpad(lower(to_hex(l_partkey)), 8, '0') END AS "RestHeader",
  qty AS "SrcVlan", 1 AS "SrcPriority", qty + 1 AS "DstVlan", 2 AS "DstPriority", {_addr('10.255', 'l_suppkey')} AS "NextHop", 24 AS "SrcMask", 16 AS "DstMask" FROM good"""
    sql["parse_sflow_messages"] = f"WITH {SF} " + " UNION ALL ".join(_counter_words_sql(place, kind) for place, kind in enumerate(_KINDS, 1))
    sql["tee_raw"] = sql["stream_tee_raw"] = f"""SELECT family, agent, count(*) AS n FROM (SELECT CASE WHEN l_linestatus = 'O' THEN 'ipv6' ELSE 'ipv4' END AS family,
  CASE WHEN l_linestatus = 'O' THEN {agent6} ELSE {_agent('l_suppkey')} END AS agent FROM lineitem) GROUP BY ALL"""

    # collector statistics
    sql["collector_counters"] = sql["stream_collector_counters"] = f"WITH {_EV} SELECT host, proto, count(*) AS udp_count, count(*) FILTER (decoded) AS decoded_count, count(*) FILTER (err) AS mq_error_count FROM ev GROUP BY ALL"
    sql["counter_rates"] = f"WITH {STATS} SELECT * FROM rates"
    sql["message_rate"] = sql["stream_rates"] = f"WITH {_EV} SELECT {_SECOND} AS window_start, part AS partition, count(*) AS n, count(*) // 10 AS rate FROM ev GROUP BY ALL"
    sql["gauges_latest"] = f"WITH {STATS} SELECT host, proto, ts, udp_queue, message_queue, udp_mirror_queue, workers FROM latest"
    sql["metrics_long"] = f"WITH {STATS} SELECT * FROM long WHERE value IS NOT NULL"
    sql["system_metrics_long"] = f"""WITH {STATS}, sys AS (SELECT host, ts, sum(udp_count) AS a, sum(decoded_count) AS b, sum(mq_error_count) AS c, sum(udp_queue) AS d, sum(message_queue) AS e, sum(workers) AS f FROM rates GROUP BY ALL)
  SELECT host, ts, unnest(['mem.heap.alloc', 'mem.alloc', 'mcache.inuse', 'mem.total.alloc', 'mem.heap.sys', 'num.goroutine']) AS metric, unnest([a, b, c, d, e, f])::BIGINT AS value FROM sys"""
    sql["counter_names"] = f"""WITH {STATS}, s AS (SELECT host, proto, unnest(['decoded_packets', 'mq_error', 'udp_packets', 'message_queue', 'udp_queue', 'workers', 'udp_mirror_queue']) AS k,
  unnest([decoded_count, mq_error_count, udp_count, message_queue, udp_queue, workers, udp_mirror_queue]) AS value FROM latest)
  SELECT host, 'flowlake_' || proto || '_' || k AS series, value FROM s WHERE value IS NOT NULL"""
    sql["metric_lines"] = f"WITH {STATS} SELECT metric || ',type=' || type || ',host=' || host || ' value=' || value AS value FROM long WHERE value IS NOT NULL"
    sql["metric_points_json"] = f"""WITH {STATS} SELECT '{{"metric":"' || metric || '","timestamp":' || epoch(ts)::BIGINT || ',"value":' || value || ',"tags":{{"host":"' || host || '","type":"' || type || '"}}}}' AS value
  FROM long WHERE value IS NOT NULL"""
    sql["stream_sflow_packets"] = sql["ethernet_layer"]
    return sql
