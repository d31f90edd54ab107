"""Message schemas of the four protocols (JSON form)."""

from __future__ import annotations

from flowlake.operators.sflow import COUNTERS
from flowlake.operators.sflow_messages import COUNTER_TAGS

FIELD = "struct<I:int,V:string,E:bigint>"

IPFIX_MESSAGE = f"""
    AgentID string,
    Header struct<Version:int,Length:int,ExportTime:bigint,SequenceNo:bigint,DomainID:bigint>,
    DataSets array<array<{FIELD}>>
"""

NETFLOW9_MESSAGE = f"""
    AgentID string,
    Header struct<Version:int,Count:int,SysUpTime:bigint,UNIXSecs:bigint,SeqNum:bigint,SrcID:bigint>,
    DataSets array<array<{FIELD}>>
"""

NETFLOW5_FLOW = (
    "struct<SrcAddr:string,DstAddr:string,NextHop:string,Input:int,Output:int,PktCount:bigint,L3Octets:bigint,"
    "StartTime:bigint,EndTime:bigint,SrcPort:int,DstPort:int,Padding1:int,TCPFlags:int,ProtType:int,Tos:int,"
    "SrcAsNum:int,DstAsNum:int,SrcMask:int,DstMask:int,Padding2:int>"
)

NETFLOW5_MESSAGE = f"""
    AgentID string,
    Header struct<Version:int,Count:int,SysUpTimeMSecs:bigint,UNIXSecs:bigint,UNIXNSecs:bigint,SeqNum:bigint,
                  EngType:int,EngID:int,SmpInt:int>,
    Flows array<{NETFLOW5_FLOW}>
"""

def _counter_record(kind: str) -> str:
    words = ",".join(f"{name}:{'bigint' if width == 4 else 'decimal(20,0)'}" for name, width in COUNTERS[kind][1])
    return f"{COUNTER_TAGS[kind]}:struct<{words}>"


_COUNTERS = ",".join(_counter_record(kind) for kind in COUNTER_TAGS)

SFLOW_MESSAGE = f"""
    Version bigint, IPVersion bigint, AgentSubID bigint, SequenceNo bigint, SysUpTime bigint, SamplesNo bigint,
    Samples array<struct<SequenceNo:bigint,SourceID:int,SamplingRate:bigint,SamplePool:bigint,Drops:bigint,
        Input:bigint,Output:bigint,RecordsNo:bigint,
        Records:struct<
            RawHeader:struct<
                L2:struct<SrcMAC:string,DstMAC:string,Vlan:int,EtherType:int>,
                L3:struct<Version:int,TOS:int,TotalLen:int,ID:int,Flags:int,FragOff:int,TTL:int,Protocol:int,
                          Checksum:int,TrafficClass:int,FlowLabel:int,PayloadLen:int,NextHeader:int,HopLimit:int,
                          Src:string,Dst:string>,
                L4:struct<SrcPort:int,DstPort:int,DataOffset:int,Reserved:int,Flags:int,Type:int,Code:int,RestHeader:binary>>,
            ExtSwitch:struct<SrcVlan:bigint,SrcPriority:bigint,DstVlan:bigint,DstPriority:bigint>,
            ExtRouter:struct<NextHop:string,SrcMask:bigint,DstMask:bigint>>>>,
    Counters array<struct<SequenceNo:bigint,SourceIDType:int,SourceIDIdx:int,RecordsNo:bigint,
        Records:struct<{_COUNTERS}>>>,
    IPAddress string, ColTime bigint
"""

MESSAGES = {
    "ipfix": IPFIX_MESSAGE,
    "netflowv9": NETFLOW9_MESSAGE,
    "netflowv5": NETFLOW5_MESSAGE,
    "sflow": SFLOW_MESSAGE,
}

#: Field that holds the export time in seconds, per protocol; sFlow messages have the time of their arrival.
EXPORT_SECONDS = {"ipfix": "Header.ExportTime", "netflowv9": "Header.UNIXSecs", "netflowv5": "Header.UNIXSecs", "sflow": "ColTime"}
