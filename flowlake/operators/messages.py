"""JSON messages: parse, explode, assemble, encode. All narrow but :func:`assemble_messages`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlake.functions.columns import either, settle
from flowlake.plans.schemas import EXPORT_SECONDS, MESSAGES


def _parsed(lines: DataFrame, proto: str, value: str) -> DataFrame:
    """Message columns and ``_bad``; every text is parsed once.

    ``inline`` rather than a struct column: a filter on generated columns stays above the
    generator, while one on a struct column would be pushed down with a copy of the parser.
    """
    schema = MESSAGES[proto] + ", _bad string"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    return lines.select("*", F.inline_outer(F.array(F.from_json(F.col(value), schema, options))))


def parse_messages(lines: DataFrame, proto: str = "ipfix", value: str = "value") -> DataFrame:
    """Typed messages from JSON text in column ``value``; text that is not JSON is left out.

    ``V`` keeps the text of the JSON value, so whole numbers of any size stay exact.
    """
    good = _parsed(lines.where(F.col(value).isNotNull()), proto, value).where(F.col("_bad").isNull())
    return good.drop("_bad", value)


def bad_messages(lines: DataFrame, proto: str = "ipfix", value: str = "value") -> DataFrame:
    """The lines :func:`parse_messages` leaves out."""
    parsed = _parsed(lines, proto, value)
    return parsed.where(F.col(value).isNull() | F.col("_bad").isNotNull()).select(*lines.columns)


def drop_empty(messages: DataFrame, column: str = "DataSets") -> DataFrame:
    """Messages that carry at least one record."""
    return messages.where(F.size(column) > 0)


def explode_records(messages: DataFrame) -> DataFrame:
    """One row per record: ``record_ix`` (from 0) and its ``fields``."""
    others = [c for c in messages.columns if c != "DataSets"]
    return messages.select(*others, F.posexplode("DataSets").alias("record_ix", "fields"))


def explode_fields(records: DataFrame) -> DataFrame:
    """One row per field: ``field_ix``, ``element_id``, ``value``, ``enterprise`` (0 when absent)."""
    others = [c for c in records.columns if c != "fields"]
    rows = records.select(*others, F.posexplode("fields").alias("field_ix", "f"))
    return rows.select(
        *others,
        "field_ix",
        F.col("f.I").alias("element_id"),
        F.col("f.V").alias("value"),
        F.coalesce(F.col("f.E"), F.lit(0)).alias("enterprise"),
    )


def export_timestamp(messages: DataFrame, proto: str = "ipfix") -> DataFrame:
    """Adds ``export_time`` (UTC) from the message's epoch seconds."""
    seconds = F.coalesce(F.col(EXPORT_SECONDS[proto]), F.lit(0))
    return messages.withColumn("export_time", F.timestamp_seconds(seconds))


def assemble_messages(records: DataFrame, keys: list[str]) -> DataFrame:
    """Records back to one row per message, in record order.

    ``keys`` identify a message; it holds what one datagram held (64 KiB at most), so the
    collected array is bounded.
    """
    rows = F.collect_list(F.struct("record_ix", "fields"))
    return (
        records.groupBy(*keys)
        .agg(F.array_sort(rows).alias("_rows"))
        .select(*keys, F.col("_rows.fields").alias("DataSets"))
    )


def _json_value(field: Column) -> Column:
    # whole numbers need no JSON parser; NaN and Infinity are no JSON numbers, they stay as text
    whole = field["V"].rlike("^(0|-?[1-9][0-9]{0,17})$")
    number = either(whole, field["V"].try_cast("bigint").cast("variant"), F.try_parse_json(field["V"]))
    text = field["V"].cast("variant")
    return either(field["num"], F.coalesce(number, text), text)


def _enterprise(field: Column) -> Column:
    return F.nullif(field["E"], F.lit(0))


def _field_text(field: Column) -> Column:
    """JSON text of a field. Whole numbers and texts without signs to escape, the usual cases, are their own JSON text."""
    other = F.to_json(_json_value(field))
    number = either(field["V"].rlike(r"^(0|-?[1-9][0-9]{0,17})\z"), field["V"], other)
    text = either(field["V"].rlike(r"^[ !#-\[\]-~]*\z"), F.concat(F.lit('"'), field["V"], F.lit('"')), other)
    value, owner = either(field["num"], number, text), _enterprise(field)
    whole = F.struct(field["I"].alias("I"), _json_value(field).alias("V"), owner.alias("E"))
    end = either(owner.isNull(), F.lit("}"), F.concat(F.lit(',"E":'), owner.cast("string"), F.lit("}")))
    usual = F.concat(F.lit('{"I":'), field["I"].cast("string"), F.lit(',"V":'), value, end)
    return either(field["I"].isNull() | field["V"].isNull(), F.to_json(whole), usual)


def _joined(values: Column, text) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(values, text), ","), F.lit("]"))


def encode_message(messages: DataFrame, flat: bool = False, value: str = "value") -> DataFrame:
    """JSON text of ``AgentID``, ``Header`` and ``DataSets`` in column ``value``.

    List form: a record is ``[{"I":…,"V":…,"E":…}]`` with ``E`` only for enterprise elements.
    Flat form: a record is ``{"id":value,…}``; where an id repeats, the last value counts.
    Fields need ``num``: whether the value is a JSON number or boolean.
    """
    others = [c for c in messages.columns if c not in ("AgentID", "Header", "DataSets")]
    if not flat:
        sets = _joined(F.col("DataSets"), lambda record: F.coalesce(_joined(record, _field_text), F.lit("null")))
        parts = messages.select(*others, F.to_json(F.struct("AgentID", "Header")).alias("_head"), sets.alias("_sets"))
        begin = F.substring("_head", F.lit(1), F.length("_head") - 1)
        text = F.concat(begin, either(F.col("_head") == "{}", F.lit(""), F.lit(",")), F.lit('"DataSets":'), F.col("_sets"), F.lit("}"))
        return parts.select(*others, F.coalesce(text, "_head").alias(value))

    def record(fields):
        pairs = F.transform(fields, lambda f: F.struct(f["I"].cast("string").alias("k"), _json_value(f).alias("v")))
        ids = fields["I"]
        last = F.filter(
            pairs, lambda p, i: F.array_position(F.slice(ids, i + 2, F.size(ids)), p["k"].cast("int")) == 0
        )
        return F.map_from_entries(last)

    body = F.struct("AgentID", "Header", F.transform("DataSets", record).alias("DataSets"))
    return messages.select(*others, F.to_json(body).alias(value))


def encode_struct(messages: DataFrame, columns: list[str], value: str = "value") -> DataFrame:
    """JSON text of fixed columns, for protocols whose messages have a fixed layout."""
    others = [c for c in messages.columns if c not in columns]
    # whoever filters the text would otherwise have the message assembled once more
    return settle(messages.select(*others, F.to_json(F.struct(*columns)).alias(value)), value)
