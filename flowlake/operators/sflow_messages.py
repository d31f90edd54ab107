"""sFlow datagrams as nested messages: one row per datagram, with its flow samples, counter samples and their tagged records.

Everything is assembled inside the datagram's own row, for whole Arrow batches at once (:mod:`flowlake.functions.sampled_messages`), so
there is no exchange. The places of samples, records and packet layers are lists of numbers first; the bytes are cut last.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlake.functions.columns import settle
from flowlake.functions.sampled import Datagrams
from flowlake.functions.sampled_messages import read_messages
from flowlake.operators import sflow as sf

# Names of the counter records in a message.
COUNTER_TAGS = {"generic": "GenInt", "ethernet": "EthInt", "tokenring": "TRInt", "vg": "VGInt", "vlan": "Vlan", "processor": "Proc"}

_TAGGED = {tag: sf.COUNTERS[kind] for kind, tag in COUNTER_TAGS.items()}
_LINK = "struct<SrcMAC:string,DstMAC:string,Vlan:int,EtherType:int>"
_NETWORK = (
    "struct<Version:int,TOS:int,TotalLen:int,ID:int,Flags:int,FragOff:int,TTL:int,Protocol:int,Checksum:int,"
    "TrafficClass:int,FlowLabel:int,PayloadLen:int,NextHeader:int,HopLimit:int,Src:string,Dst:string>"
)
_TRANSPORT = "struct<SrcPort:int,DstPort:int,DataOffset:int,Reserved:int,Flags:int,Type:int,Code:int,RestHeader:binary>"
_SWITCH = "struct<SrcVlan:bigint,SrcPriority:bigint,DstVlan:bigint,DstPriority:bigint>"
_ROUTER = "struct<NextHop:string,SrcMask:bigint,DstMask:bigint>"

#: Columns of a message, in order.
MESSAGE = ["Version", "IPVersion", "AgentSubID", "SequenceNo", "SysUpTime", "SamplesNo", "Samples", "Counters", "IPAddress", "ColTime"]


def _message_type() -> str:
    """Spark type of what is read of a datagram."""
    def record(tag: str) -> str:
        return f"{tag}:struct<{','.join(f'{name}:{"bigint" if width == 4 else "decimal(20,0)"}' for name, width in _TAGGED[tag][1])}>"

    samples = (
        "struct<SequenceNo:bigint,SourceID:int,SamplingRate:bigint,SamplePool:bigint,Drops:bigint,Input:bigint,Output:bigint,RecordsNo:bigint,"
        f"Records:struct<RawHeader:struct<L2:{_LINK},L3:{_NETWORK},L4:{_TRANSPORT}>,ExtSwitch:{_SWITCH},ExtRouter:{_ROUTER}>>"
    )
    counters = f"struct<SequenceNo:bigint,SourceIDType:int,SourceIDIdx:int,RecordsNo:bigint,Records:struct<{','.join(map(record, _TAGGED))}>>"
    return f"struct<error:string,Samples:array<{samples}>,Counters:array<{counters}>>"


def sflow_messages(
    datagrams: DataFrame, exclude_types: list[int] | None = None, on_error: str = "drop_datagram", legacy: bool = False
) -> DataFrame:
    """One message per datagram that has a sample; ``encode_struct(…, MESSAGE)`` makes its JSON text.

    Excluded and unknown samples are left out. ``drop_datagram``: one bad sample spoils its datagram. ``keep_samples``: only
    the bad samples go. A record format that a sample lacks is a null struct, hence absent from JSON.
    """
    keep = [c for c in ("agent", "recv_ts", "msg_id") if c in datagrams.columns]
    wanted, form = sf.wanted_samples(exclude_types, on_error), _TAGGED

    def read(payload: pa.Array, base: pa.Array, count: pa.Array) -> pa.Array:
        return read_messages(Datagrams(payload, base, count, wanted, sf.COUNTER_BYTES), form, legacy)

    rows = sf.sflow_header(datagrams).withColumn("message", F.arrow_udf(read, _message_type())("payload", "base", "SamplesNo"))
    rows = settle(rows.drop("payload"), "message").where((F.size("message.Samples") > 0) | (F.size("message.Counters") > 0))
    good = rows.where("message.error IS NULL") if on_error == "drop_datagram" else rows
    return good.select(*keep, *sf.HEADER, "message.Samples", "message.Counters").select(*keep, *MESSAGE)
