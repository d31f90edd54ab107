"""NetFlow v9 jobs; the stages are those of IPFIX with other framing."""

from __future__ import annotations

from pyspark.sql import DataFrame

from flowlake.operators import records as r
from flowlake.operators import templates as t
from flowlake.operators.templates import NETFLOW9


def netflow9_header(datagrams: DataFrame) -> DataFrame:
    """Header fields of every v9 packet."""
    return r.message_header(datagrams, NETFLOW9).select("agent", "recv_ts", "msg_id", "Header.*")


def netflow9_sets(datagrams: DataFrame) -> DataFrame:
    """One row per flow set; ids 2 to 255 are reserved and carry nothing."""
    return t.sets_of(datagrams, NETFLOW9)


def netflow9_templates(datagrams: DataFrame) -> DataFrame:
    """One row per announced template."""
    return t.template_records(datagrams, NETFLOW9)


def netflow9_table(datagrams: DataFrame, elements: DataFrame, registry: DataFrame | None = None, **options) -> DataFrame:
    """One row per data record; options as for :func:`flowlake.operators.records.records_table`."""
    return r.records_table(datagrams, NETFLOW9, elements, registry, **options)


def netflow9_report(datagrams: DataFrame, elements: DataFrame, registry: DataFrame | None = None, **options) -> DataFrame:
    """Counts of what gave no records; options as for :func:`flowlake.operators.records.decode_report`."""
    return r.decode_report(datagrams, NETFLOW9, elements, registry, **options)
