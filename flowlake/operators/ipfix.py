"""IPFIX jobs: header, sets, templates, records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlake.operators import records as r
from flowlake.operators import templates as t
from flowlake.operators.templates import IPFIX


def ipfix_header(datagrams: DataFrame) -> DataFrame:
    """Header fields of every IPFIX message."""
    return r.message_header(datagrams, IPFIX).select("agent", "recv_ts", "msg_id", "Header.*")


def ipfix_sets(datagrams: DataFrame) -> DataFrame:
    """One row per set of every message."""
    return t.sets_of(datagrams, IPFIX)


def template_table(datagrams: DataFrame) -> DataFrame:
    """One row per announced template."""
    return t.template_records(datagrams, IPFIX)


def option_template_records(datagrams: DataFrame) -> DataFrame:
    """Only the option templates."""
    return template_table(datagrams).where("is_option")


def ipfix_table(datagrams: DataFrame, elements: DataFrame, registry: DataFrame | None = None, **options) -> DataFrame:
    """One row per data record; options as for :func:`flowlake.operators.records.records_table`."""
    return r.records_table(datagrams, IPFIX, elements, registry, **options)


def ipfix_flow_rows(datagrams: DataFrame, elements: DataFrame, registry: DataFrame | None = None, **options) -> DataFrame:
    """Wide flow rows; options as for :func:`flowlake.operators.records.flow_table`."""
    return r.flow_table(datagrams, IPFIX, elements, registry, **options)


def ipfix_report(datagrams: DataFrame, elements: DataFrame, registry: DataFrame | None = None, **options) -> DataFrame:
    """Counts of what gave no records; options as for :func:`flowlake.operators.records.decode_report`."""
    return r.decode_report(datagrams, IPFIX, elements, registry, **options)


def flow_records(records: DataFrame) -> DataFrame:
    """Records that describe flows: those of option templates (with scope fields) are left out."""
    return records.where(~F.exists("fields", lambda f: f["scope"]))
