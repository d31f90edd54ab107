"""Layers of a sampled packet: Ethernet, IPv4/IPv6, TCP/UDP/ICMP.

``packet_layers`` is a chain of projections over one binary column; a layer that is not
there is a null struct. ``packet_error`` names what makes a packet unreadable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlake.functions import bytes as b
from flowlake.functions.columns import either

# Header protocols, ether types, IP protocols.
ETHERNET, RAW_IPV4, RAW_IPV6 = 1, 11, 12
TYPE_IPV4, TYPE_IPV6, TYPE_VLAN = 0x0800, 0x86DD, 0x8100
ICMP, TCP, UDP, ICMPV6 = 1, 6, 17, 58


def ether_type(header: str) -> str:
    """SQL text: the outer type of an Ethernet header."""
    return _word(header, "12")


def network_place(header: str, protocol: str, outer: str) -> tuple[str, str]:
    """SQL text: offset of the network layer, and its kind (4, 6, or 0 when unknown), by the outer type."""
    inner = _word(header, "16")
    tagged = f"({protocol} = {ETHERNET} AND {outer} = {TYPE_VLAN})"
    offset = f"IF({protocol} != {ETHERNET}, 0, IF({tagged}, 18, 14))"

    def framed(number: str) -> str:
        return f"IF({number} = {TYPE_IPV4}, 4, IF({number} = {TYPE_IPV6}, 6, 0))"

    kind = (
        f"IF({protocol} = {RAW_IPV4}, 4, IF({protocol} = {RAW_IPV6}, 6, IF({protocol} = {ETHERNET}, "
        f"IF({outer} = {TYPE_VLAN}, {framed(inner)}, {framed(outer)}), 0)))"
    )
    return offset, kind


def _word(header: str, offset: str) -> str:
    return f"CAST(conv(hex(substring({header}, {offset} + 1, 2)), 16, 10) AS INT)"


def _byte(header: str, offset: str) -> str:
    return f"CAST(conv(hex(substring({header}, {offset} + 1, 1)), 16, 10) AS INT)"


def transport_place(header: str, at: str, kind: str, legacy: bool = False) -> str:
    """SQL text: offset of the transport layer. IPv4 options count, but not with ``legacy``."""
    four = "20" if legacy else f"greatest(({_byte(header, at)} & 15) * 4, 20)"
    return f"CAST({at} + IF({kind} = 4, {four}, 40) AS INT)"


def packet_error(header: str, protocol: str, at: str, kind: str, transport_at: str) -> str:
    """SQL text: null for a readable packet, else the reason."""
    rest = f"(length({header}) - {transport_at})"
    number = _byte(header, f"{at} + IF({kind} = 4, 9, 6)")
    # a header that is long enough for every known transport layer needs only the layer's number
    short = (
        f"IF({number} = {TCP}, IF({rest} < 20, 'short TCP header', NULL), IF({number} = {UDP}, IF({rest} < 8, 'short UDP header', NULL), "
        f"IF({number} IN ({ICMP}, {ICMPV6}), IF({rest} < 5, 'short ICMP header', NULL), 'unknown transport layer')))"
    )
    known = f"{number} IN ({ICMP}, {TCP}, {UDP}, {ICMPV6})"
    transport = f"IF({rest} >= 20, IF({known}, NULL, 'unknown transport layer'), {short})"
    return (
        f"IF({protocol} NOT IN ({ETHERNET}, {RAW_IPV4}, {RAW_IPV6}), 'unknown header protocol', "
        f"IF({protocol} = {ETHERNET} AND length({header}) < 14, 'short Ethernet header', "
        f"IF({kind} = 0, 'unknown ether type', "
        f"IF({rest} < 0, IF({kind} = 4, 'short IPv4 header', 'short IPv6 header'), {transport}))))"
    )


def ethernet_layer(header: Column, outer: Column, addresses: Column) -> Column:
    """MACs, ether type, and one 802.1Q tag: ``Vlan`` is the whole tag word, ``vlan_id`` its low 12 bits.

    ``outer`` is the type that follows the addresses, ``addresses`` their hex digits.
    """
    tagged = outer == TYPE_VLAN
    tag = either(tagged, b.u16(header, 14), F.lit(0))
    return F.struct(
        b.mac_at(addresses, 1).alias("SrcMAC"),
        b.mac_at(addresses, 0).alias("DstMAC"),
        tag.alias("Vlan"),
        tag.bitwiseAND(F.lit(0xFFF)).alias("vlan_id"),
        either(tagged, b.u16(header, 16), outer).alias("EtherType"),
    )


def ethernet_addresses(header: Column) -> Column:
    """Both addresses as lower-case hex digits."""
    return F.lower(F.hex(b.cut(header, 0, 12)))


def ipv4_words(header: Column, at: Column) -> dict[str, Column]:
    """The IPv4 header as three numbers: its first eight bytes, the next four, the addresses."""
    return {"first": b.word(header, at), "second": b.u32(header, at + 8), "ends": b.word(header, at + 12)}


def ipv4_layer(first: Column, second: Column, ends: Column, legacy: bool = False) -> Column:
    """IPv4 header from :func:`ipv4_words`. ``legacy`` reads flags as the low bits of their byte and no fragment offset."""
    return F.struct(
        b.bits(first, 60, 4).alias("Version"),
        b.bits(first, 48, 8).alias("TOS"),
        b.bits(first, 32, 16).alias("TotalLen"),
        b.bits(first, 16, 16).alias("ID"),
        (b.bits(first, 8, 3) if legacy else b.bits(first, 13, 3)).alias("Flags"),
        (F.lit(0) if legacy else b.bits(first, 0, 13)).alias("FragOff"),
        b.bits(second, 24, 8).alias("TTL"),
        b.bits(second, 16, 8).alias("Protocol"),
        b.bits(second, 0, 16).alias("Checksum"),
        b.ipv4_number_text(b.bits(ends, 32, 32, "bigint")).alias("Src"),
        b.ipv4_number_text(b.bits(ends, 0, 32, "bigint")).alias("Dst"),
    )


def ipv6_layer(header: Column, at: Column) -> Column:
    first = b.u32(header, at)
    return F.struct(
        F.shiftright(first, 28).cast("int").alias("Version"),
        F.shiftright(first, 20).bitwiseAND(F.lit(0xFF)).cast("int").alias("TrafficClass"),
        first.bitwiseAND(F.lit(0xFFFFF)).cast("int").alias("FlowLabel"),
        b.u16(header, at + 4).alias("PayloadLen"),
        b.u8(header, at + 6).alias("NextHeader"),
        b.u8(header, at + 7).alias("HopLimit"),
        b.ipv6_text(header, at + 8).alias("Src"),
        b.ipv6_text(header, at + 24).alias("Dst"),
    )


def tcp_layer(ports: Column, flags: Column) -> Column:
    """Ports, data offset, and nine flag bits (NS included), from the first four bytes and the two at 12."""
    return F.struct(
        b.bits(ports, 16, 16).alias("SrcPort"),
        b.bits(ports, 0, 16).alias("DstPort"),
        b.bits(flags, 12, 4).alias("DataOffset"),
        F.lit(0).alias("Reserved"),
        b.bits(flags, 0, 9).alias("Flags"),
    )


def udp_layer(ports: Column) -> Column:
    return F.struct(b.bits(ports, 16, 16).alias("SrcPort"), b.bits(ports, 0, 16).alias("DstPort"))


def icmp_layer(header: Column, at: Column) -> Column:
    return F.struct(
        b.u8(header, at).alias("Type"),
        b.u8(header, at + 1).alias("Code"),
        b.cut(header, at + 4, F.length(header)).alias("RestHeader"),
    )


def packet_layers(packets: DataFrame, legacy: bool = False, checked: bool = False) -> DataFrame:
    """Adds ``l2, l3_v4, l3_v6, l4_tcp, l4_udp, l4_icmp`` and ``packet_error`` to rows with
    ``protocol`` and ``header`` bytes. Rows known to be readable pass ``checked``.

    The IPv4 header is taken as 20 bytes with ``legacy``; otherwise its length field counts.
    """
    header, names = F.col("header"), packets.columns
    # numbers that several fields are cut from are columns of their own, so that each is read once
    typed = packets.selectExpr("*", f"{ether_type('header')} AS l2_type")
    offset, kind = network_place("header", "protocol", "l2_type")
    placed = typed.selectExpr("*", f"{offset} AS l3_at", f"{kind} AS l3_kind")
    placed = placed.selectExpr("*", f"{transport_place('header', 'l3_at', 'l3_kind', legacy)} AS l4_at")
    error = "CAST(NULL AS STRING)" if checked else packet_error("header", "protocol", "l3_at", "l3_kind", "l4_at")
    four, six = F.col("l3_kind") == 4, F.col("l3_kind") == 6
    deeper = placed.select(
        "*",
        F.expr(error).alias("packet_error"),
        b.u8(header, F.col("l3_at") + F.when(four, 9).otherwise(6)).alias("ip_protocol"),
    )
    fine = F.col("packet_error").isNull()
    link, number, at = (F.col("protocol") == ETHERNET) & fine, F.col("ip_protocol"), F.col("l4_at")
    read = deeper.select(
        "*",
        F.when(link, ethernet_addresses(header)).alias("_addresses"),
        *[F.when(four & fine, word).alias(f"_{name}") for name, word in ipv4_words(header, F.col("l3_at")).items()],
        F.when(number.isin(TCP, UDP) & fine, b.u32(header, at)).alias("_ports"),
        F.when((number == TCP) & fine, b.u16(header, at + 12)).alias("_flags"),
    )
    return read.select(
        *names,
        "packet_error",
        F.when(link, ethernet_layer(header, F.col("l2_type"), F.col("_addresses"))).alias("l2"),
        F.when(four & fine, ipv4_layer(F.col("_first"), F.col("_second"), F.col("_ends"), legacy)).alias("l3_v4"),
        F.when(six & fine, ipv6_layer(header, F.col("l3_at"))).alias("l3_v6"),
        F.when((number == TCP) & fine, tcp_layer(F.col("_ports"), F.col("_flags"))).alias("l4_tcp"),
        F.when((number == UDP) & fine, udp_layer(F.col("_ports"))).alias("l4_udp"),
        F.when(number.isin(ICMP, ICMPV6) & fine, icmp_layer(header, at)).alias("l4_icmp"),
    )
