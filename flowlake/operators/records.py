"""Data records of template protocols: slice resolved sets into fields.

Stages: resolve the template of every set (no shuffle of sets where the versions are few, see
:func:`flowlake.operators.templates.resolve_templates`), work out where the records of a set
start, settle what a broken set does to its message, slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlake.functions import bytes as b
from flowlake.functions.columns import settle
from flowlake.functions.values import column_texts, is_literal, value_text
from flowlake.operators import templates as t
from flowlake.operators.flows import PROFILES
from flowlake.operators.templates import Framing
from flowlake.session import stored


def keys_of(frame: DataFrame) -> tuple[str, ...]:
    """What a template id belongs to: the agent, and the observation domain where rows carry one."""
    return ("agent", "domain") if "domain" in frame.columns else ("agent",)


def with_domain(datagrams: DataFrame, framing: Framing) -> DataFrame:
    """Adds ``domain`` (IPFIX observation domain, v9 source id), so that domains behind one agent have templates of their own."""
    return datagrams.withColumn("domain", b.u32(F.col("payload"), 12 if framing.proto == "ipfix" else 16))


def header_columns(framing: Framing) -> list[str]:
    """The message header as one struct."""
    payload = F.col("payload")
    if framing.proto == "ipfix":
        fields = [
            b.u16(payload, 0).alias("Version"),
            b.u16(payload, 2).alias("Length"),
            b.u32(payload, 4).alias("ExportTime"),
            b.u32(payload, 8).alias("SequenceNo"),
            b.u32(payload, 12).alias("DomainID"),
        ]
    else:
        fields = [
            b.u16(payload, 0).alias("Version"),
            b.u16(payload, 2).alias("Count"),
            b.u32(payload, 4).alias("SysUpTime"),
            b.u32(payload, 8).alias("UNIXSecs"),
            b.u32(payload, 12).alias("SeqNum"),
            b.u32(payload, 16).alias("SrcID"),
        ]
    return F.struct(*fields).alias("Header")


def message_header(datagrams: DataFrame, framing: Framing) -> DataFrame:
    """One row per well-versioned message with its ``Header``."""
    payload = F.col("payload")
    fits = (F.length(payload) >= framing.header_bytes) & (b.u16(payload, 0) == framing.version)
    return datagrams.where(fits).withColumn("Header", header_columns(framing))


def announcements(datagrams: DataFrame, framing: Framing, registry: DataFrame | None = None) -> DataFrame:
    """Templates seen in the datagrams, plus those of an earlier registry."""
    columns = [*keys_of(datagrams), "template_id", *t.ORDER, "rec_ix", "fields"]
    seen = t.template_records(datagrams, framing).select(*columns)
    return seen if registry is None else seen.unionByName(registry.select(*columns))


def versions_and_layouts(
    datagrams: DataFrame, framing: Framing, elements: DataFrame, registry: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Change points of all templates by the name of their field list, and the dictionary of field lists, ready to slice with."""
    announced = stored(t.with_layout(announcements(datagrams, framing, registry)))
    versions = stored(t.template_versions(announced, keys_of(datagrams), content="layout"))
    return versions, stored(t.layouts(announced, elements, framing.enterprise))


def resolved_sets(datagrams: DataFrame, framing: Framing, versions: DataFrame, layouts: DataFrame) -> DataFrame:
    """Every data set with its typed template; the template's columns are null where unknown. Bytes do not move."""
    sets = t.data_sets(message_header(datagrams, framing), framing)
    named = t.hinted(layouts.count(), layouts)[0]
    return t.resolve_templates(sets, versions, keys_of(datagrams)).join(named, "layout", "left")


def judged_sets(
    datagrams: DataFrame, framing: Framing, versions: DataFrame, layouts: DataFrame, on_unknown: str = "drop_set", again: bool = False
) -> DataFrame:
    """Resolved sets with their status (:func:`set_status`).

    ``again``: the sets will be read more than once. They are stored then, judged and with the name of their field list only, so that
    finding broken messages reads a few columns, and neither the walk nor the lookup is done twice.
    """
    status = set_status(resolved_sets(datagrams, framing, versions, layouts), framing, on_unknown)
    if not again:
        return status
    typed = [c for c in layouts.columns if c != "layout"]
    named = t.hinted(layouts.count(), layouts)[0]
    return stored(status.drop(*typed, "valid_from", "valid_to")).join(named, "layout", "left")


_SPAN = "struct<off:int,len:int>"


def _variable_starts() -> str:
    """SQL fold over the records of a set whose fields include lengths of their own.

    Inside a record a second fold moves the cursor over the template's fields. A length is one
    byte, or 255 and two bytes.
    """
    byte = "CAST(conv(hex(substring(body, c.pos + 1, 1)), 16, 10) AS INT)"
    word = "CAST(conv(hex(substring(body, c.pos + 2, 2)), 16, 10) AS INT)"
    skip = f"IF(f.variable, IF({byte} = 255, 3, 1), 0)"
    size = f"IF(f.variable, IF({byte} = 255, {word}, {byte}), f.length)"
    record = f"""aggregate(fields, named_struct('pos', a.pos, 'spans', CAST(array() AS array<{_SPAN}>)), (c, f) ->
        named_struct('pos', coalesce(c.pos + {skip} + {size}, 1000000),
                     'spans', concat(c.spans, array(named_struct('off', coalesce(c.pos + {skip}, 0), 'len', coalesce({size}, 0))))))"""
    return f"""aggregate(sequence(1, length(body) div greatest(record_bytes, 1) + 1),
        named_struct('pos', 0, 'done', false, 'bad', false, 'records', CAST(array() AS array<array<{_SPAN}>>)), (a, i) -> CASE
        WHEN a.done OR length(body) - a.pos <= 4 THEN named_struct('pos', a.pos, 'done', true, 'bad', a.bad, 'records', a.records)
        ELSE element_at(transform(array({record}), r -> IF(r.pos > length(body),
            named_struct('pos', a.pos, 'done', true, 'bad', true, 'records', a.records),
            named_struct('pos', r.pos, 'done', false, 'bad', false, 'records', concat(a.records, array(r.spans))))), 1) END)"""


def set_status(resolved: DataFrame, framing: Framing, on_unknown: str = "drop_set") -> DataFrame:
    """Adds ``reason`` (why a set gives no records, or ends early), ``fatal``, and the record plan.

    A template with an element that the dictionary lacks gives no records (``on_unknown="drop_set"``), or that element is read
    as bytes of its length (``"hex"``).
    Up to four bytes after the last record are padding. ``starts`` counts the records of fixed
    size; ``spans`` lists the field places of records of variable size.
    """
    if on_unknown not in ("drop_set", "hex"):
        raise ValueError(f"on_unknown must be 'drop_set' or 'hex', not {on_unknown!r}")
    unknown = F.col("unknown_element").isNotNull() & F.lit(on_unknown == "drop_set")
    usable = F.col("fields").isNotNull() & ~unknown & (F.col("record_bytes") > 0)
    fixed = usable & ~F.col("variable")
    planned = resolved.select(
        "*",
        F.when(
            fixed & (F.length("body") > 4),
            F.least(
                F.expr("length(body) div record_bytes"), F.expr("(length(body) - 5) div record_bytes + 1")
            ).cast("int"),
        ).otherwise(F.lit(0)).alias("starts"),
        F.explode(F.array(F.when(usable & F.col("variable"), F.expr(_variable_starts())))).alias("walked"),
    )
    tail = F.length("body") - F.col("starts") * F.col("record_bytes")
    reason = (
        F.when(F.col("message_error").isNotNull(), F.col("message_error"))
        .when(F.col("valid_from").isNull(), "unknown template")
        .when(unknown, "unknown element")
        .when(F.coalesce(F.col("record_bytes"), F.lit(0)) == 0, "empty template")
        .when((fixed & (tail > 4)) | F.coalesce(F.col("walked.bad"), F.lit(False)), "set does not end on a record")
    )
    return planned.withColumn("reason", reason).withColumn(
        "fatal",
        F.col("reason").isNotNull() & ~F.coalesce(F.col("reason").isin("unknown template", "unknown element"), F.lit(False)),
    )


def fatal_messages(status: DataFrame) -> DataFrame:
    """Messages in which a set ends amiss, with the first such set: keys only, and few, for broken sets are rare."""
    message = [*keys_of(status), "recv_ts", "msg_id"]
    bad = status.where(F.col("fatal") & F.col("message_error").isNull())
    found = stored(bad.groupBy(*message).agg(F.min("set_ix").alias("first_bad")))
    return t.hinted(found.count(), found)[0]


def usable_sets(status: DataFrame, framing: Framing, on_error: str = "drop_message") -> DataFrame:
    """Sets whose records count.

    IPFIX, ``drop_message``: a fatal set spoils its whole message. v9, ``drop_message``: records up
    to and inside the broken set stay, later sets of the message go. Both first find the messages concerned, as keys, and join
    those to the sets, which stay where they are. ``keep_sets`` judges every set alone.
    """
    if on_error not in ("drop_message", "keep_sets"):
        raise ValueError(f"on_error must be 'drop_message' or 'keep_sets', not {on_error!r}")
    skipped = F.coalesce(F.col("reason").isin("unknown template", "unknown element", "empty template"), F.lit(False))
    good = status.where(~skipped)
    if on_error == "keep_sets":
        return good.where(~F.col("fatal")) if framing.proto == "ipfix" else good
    bad, message = fatal_messages(status), [*keys_of(status), "recv_ts", "msg_id"]
    if framing.proto == "ipfix":
        return good.where(F.col("message_error").isNull()).join(bad, message, "left_anti")
    return good.join(bad, message, "left").where("first_bad IS NULL OR set_ix <= first_bad").drop("first_bad")


def record_plan() -> Column:
    """One entry per record of a set: null for a record of fixed size, else its field places."""
    empty = F.lit(None).cast(f"array<{_SPAN}>")
    return F.when(F.col("variable"), F.col("walked.records")).otherwise(F.array_repeat(empty, F.col("starts")))


def slice_records(sets: DataFrame, reduced_size: str = "hex") -> DataFrame:
    """One row per record with its ``fields``: ``I`` id, ``V`` text, ``E`` enterprise, ``num``, ``scope``."""
    keep = [c for c in (*keys_of(sets), "recv_ts", "msg_id", "Header", "set_ix", "template_id") if c in sets.columns]
    planned = settle(
        sets.select(*keep, "body", "record_bytes", F.col("fields").alias("template"), record_plan().alias("plan")), "plan"
    )
    rows = planned.select(*keep, "body", "record_bytes", "template", F.posexplode("plan").alias("record_ix", "spans"))

    def field(f, i):
        raw = F.when(
            F.col("spans").isNull(), b.cut(F.col("body"), F.col("record_ix") * F.col("record_bytes") + f["off"], f["length"])
        ).otherwise(b.cut(F.col("body"), F.get("spans", i)["off"], F.get("spans", i)["len"]))
        return F.struct(
            f["element_id"].alias("I"), raw.alias("raw"), f["enterprise"].alias("E"), f["scope"].alias("scope"),
            f["kind"].alias("kind"), f["width"].alias("width"),
        )

    def text(f):
        return F.struct(
            f["I"].alias("I"),
            value_text(f["raw"], f["kind"], f["width"], reduced_size).alias("V"),
            f["E"].alias("E"),
            is_literal(f["raw"], f["kind"], f["width"], reduced_size).alias("num"),
            f["scope"].alias("scope"),
        )

    cut = rows.select(*keep, "record_ix", F.transform("template", field).alias("cut"))
    # whoever explodes or filters the fields would otherwise have them read once more
    return settle(cut.select(*keep, "record_ix", F.transform("cut", text).alias("fields")), "fields")


def records_table(
    datagrams: DataFrame,
    framing: Framing,
    elements: DataFrame,
    registry: DataFrame | None = None,
    reduced_size: str = "hex",
    on_error: str = "drop_message",
    on_unknown: str = "drop_set",
) -> DataFrame:
    """One row per data record of the datagrams."""
    known = versions_and_layouts(datagrams, framing, elements, registry)
    status = judged_sets(datagrams, framing, *known, on_unknown, again=on_error == "drop_message")
    records = slice_records(usable_sets(status, framing, on_error), reduced_size)
    seconds = F.col("Header.ExportTime") if framing.proto == "ipfix" else F.col("Header.UNIXSecs")
    return records.withColumn("AgentID", F.col("agent")).withColumn("export_time", F.timestamp_seconds(seconds))


def unresolved_sets(
    datagrams: DataFrame,
    framing: Framing,
    elements: DataFrame,
    registry: DataFrame | None = None,
    on_error: str = "keep_sets",
    on_unknown: str = "drop_set",
) -> DataFrame:
    """Data sets that gave no or not all records, with the reason and their bytes for a replay.

    With ``on_error="drop_message"`` also the good sets that fall with a broken one of their message, as "message dropped".
    """
    known = versions_and_layouts(datagrams, framing, elements, registry)
    status = judged_sets(datagrams, framing, *known, on_unknown, again=on_error == "drop_message")
    if on_error == "drop_message":
        status = status.join(fatal_messages(status), [*keys_of(status), "recv_ts", "msg_id"], "left")
        fallen = F.col("first_bad").isNotNull() & (F.lit(framing.proto == "ipfix") | (F.col("set_ix") > F.col("first_bad")))
        status = status.withColumn("reason", F.coalesce("reason", F.when(fallen, "message dropped")))
    return status.where(F.col("reason").isNotNull()).select(
        *keys_of(status), "recv_ts", "msg_id", "set_ix", "template_id", "reason", "body"
    )


def decode_report(
    datagrams: DataFrame,
    framing: Framing,
    elements: DataFrame,
    registry: DataFrame | None = None,
    on_error: str = "drop_message",
    on_unknown: str = "drop_set",
) -> DataFrame:
    """Counts of rejected messages and undecoded sets by agent, set id and reason.

    A message whose framing or templates are broken counts once, without a set id, beside the data sets that fall with it.
    """
    payload, keys = F.col("payload"), keys_of(datagrams)
    short = F.length(payload) < framing.header_bytes
    rejects = datagrams.where(short | (b.u16(payload, 0) != framing.version)).select(
        *keys,
        F.lit(None).cast("int").alias("set_id"),
        F.when(short, "short header").otherwise("wrong version").alias("reason"),
    )
    broken = t.message_errors(datagrams, framing).select(
        *keys, F.lit(None).cast("int").alias("set_id"), F.col("message_error").alias("reason")
    )
    sets = unresolved_sets(datagrams, framing, elements, registry, on_error, on_unknown)
    sets = sets.select(*keys, F.col("template_id").alias("set_id"), "reason")
    return rejects.unionByName(broken).unionByName(sets).groupBy(*keys, "set_id", "reason").agg(F.count("*").alias("n"))


def flow_table(
    datagrams: DataFrame,
    framing: Framing,
    elements: DataFrame,
    registry: DataFrame | None = None,
    reduced_size: str = "hex",
    on_error: str = "drop_message",
    profile: str = "full",
    on_unknown: str = "drop_set",
) -> DataFrame:
    """Data records straight to wide flow rows; only the wanted fields are sliced.

    Where each column sits in a record is worked out per template, so a data record costs one
    slice and one conversion per column, in generated code. Records of option templates are no flows.
    """
    columns = PROFILES[profile]

    def place(wanted):
        own = F.filter("fields", lambda f: f["element_id"].isin(*wanted) & (f["enterprise"] == 0))
        last = F.try_element_at(own, F.lit(-1))
        return F.when(last.isNotNull(), F.struct(*[last[name].alias(name) for name in ("ix", "off", "length", "kind", "width")]))

    versions, layouts = versions_and_layouts(datagrams, framing, elements, registry)
    # fixed templates need no field list any more once the places are known
    typed = layouts.select(
        "*",
        F.exists("fields", lambda f: f["scope"]).alias("optional"),
        *[place(wanted).alias(f"_{name}") for name, wanted, _, _ in columns],
    )
    typed = typed.withColumn("fields", F.when(F.col("variable"), F.col("fields")).otherwise(F.slice("fields", 1, 0)))
    sets = usable_sets(judged_sets(datagrams, framing, versions, stored(typed), on_unknown, on_error == "drop_message"), framing, on_error)
    seconds = F.col("Header.ExportTime") if framing.proto == "ipfix" else F.col("Header.UNIXSecs")
    placed = sets.where("NOT optional").select(
        "agent", "recv_ts", "msg_id", F.timestamp_seconds(seconds).alias("export_time"), "body", "record_bytes",
        record_plan().alias("plan"),
        *[f"_{name}" for name, _, _, _ in columns],
    )
    placed = settle(placed, "plan")
    keep = ["agent", "recv_ts", "msg_id", "export_time", "body", "record_bytes", *[f"_{name}" for name, _, _, _ in columns]]
    rows = placed.select(*keep, F.posexplode("plan").alias("record_ix", "spans"))
    start = F.col("record_ix") * F.col("record_bytes")
    raws = {}
    for name, _, _, _ in columns:
        f = F.col(f"_{name}")
        span = F.get("spans", f["ix"])
        raws[f"raw_{name}"] = b.cut(
            F.col("body"), F.coalesce(span["off"], start + f["off"]), F.coalesce(span["len"], f["length"])
        )
    cut = rows.withColumns(raws)
    words = [name for name, _, type_name, _ in columns if type_name == "string"]
    texts, values = column_texts(
        [(F.col(f"raw_{name}"), F.col(f"_{name}.kind"), F.col(f"_{name}.width")) for name in words], reduced_size
    )
    cut = cut.withColumn("texts", texts)
    text_of = dict(zip(words, values, strict=True))
    wide = []
    for name, _, type_name, default in columns:
        f, raw = F.col(f"_{name}"), F.col(f"raw_{name}")
        if type_name == "string":
            value = text_of[name]
        else:
            whole = (f["kind"] == "uint") & ((F.length(raw) >= f["width"]) | F.lit(reduced_size == "widen"))
            value = F.when(whole, b.digits(b.cut(raw, 0, f["width"])).try_cast(type_name))
        wide.append(F.coalesce(value, F.lit(default).cast(type_name)).alias(name))
    lead = {
        "full": [F.col("export_time").alias("exportTime")],
        "tsv": [F.col("agent").alias("device"), F.date_format("export_time", "yyyy-MM-dd HH:mm:ss").alias("datetime")],
        "asn": [F.to_date("export_time").alias("date"), F.col("export_time").alias("time"), F.col("agent").alias("device")],
    }[profile]
    return cut.select("agent", "recv_ts", "msg_id", *lead, *wide)
