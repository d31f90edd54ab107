"""Sets, templates and the template registry of IPFIX and NetFlow v9.

A message is walked once over its set headers; that yields a short array of
``(set_id, off, len)``, and bytes are sliced later, outside of the walk.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlake.functions import bytes as b
from flowlake.functions.announced import TEMPLATES, read_announced
from flowlake.functions.columns import settle
from flowlake.functions.values import kind_of, width_of
from flowlake.operators.buckets import with_edges
from flowlake.session import stored

SPECIFIER = "struct<element_id:int,length:int,enterprise:bigint,scope:boolean>"
SET = "struct<set_id:int,off:int,len:int>"
ORDER = ["recv_ts", "msg_id", "set_ix"]


@dataclass(frozen=True)
class Framing:
    """What differs between the two template protocols."""

    proto: str
    version: int
    header_bytes: int
    template_set: int
    option_set: int
    enterprise: bool


# Fixed values of the two formats.
IPFIX = Framing("ipfix", 10, 16, 2, 3, True)
NETFLOW9 = Framing("netflowv9", 9, 20, 0, 1, False)


def _u(position: str, n: int, kind: str = "INT") -> str:
    return f"CAST(conv(hex(substring(payload, {position} + 1, {n})), 16, 10) AS {kind})"


# ------------------------------------------------------------------ set walk


def _set_walk(framing: Framing, steps: str, start: str) -> str:
    def state(pos="a.pos", done="true", error="a.error", sets="a.sets"):
        return f"named_struct('pos', {pos}, 'done', {done}, 'error', {error}, 'sets', {sets})"

    left = "(length(payload) - a.pos)"
    set_id, size = _u("a.pos", 2), _u("a.pos + 2", 2)
    one = f"array(named_struct('set_id', {set_id}, 'off', a.pos + 4, 'len', least({size}, {left}) - 4))"
    invalid = (
        f"WHEN {set_id} < 2 AND {size} > 8 THEN {state(error=quote('invalid set id'))}" if framing.enterprise else ""
    )
    return f"""aggregate(sequence(1, {steps}), {start}, (a, i) -> CASE
        WHEN a.done THEN a
        WHEN {left} <= 4 THEN {state()}
        WHEN {size} < 4 THEN {state(error=quote('set length below 4'))}
        {invalid}
        WHEN {size} > {left} THEN {state(error=quote('set runs past the end'), sets=f'concat(a.sets, {one})')}
        ELSE {state(pos=f'a.pos + {size}', done='false', sets=f'concat(a.sets, {one})')} END)"""


def quote(text: str) -> str:
    return f"'{text}'"


#: Sets read in generated code before the fold takes over.
UNROLLED_SETS = 4


def walked_messages(datagrams: DataFrame, framing: Framing) -> DataFrame:
    """Datagrams of the right version with ``walk``: their sets and an error, if any.

    The first sets are read by plain projections, one after the other; only a message with more
    sets, or a broken one, goes through the fold.
    """
    payload = F.col("payload")
    fits = (F.length(payload) >= framing.header_bytes) & (b.u16(payload, 0) == framing.version)
    columns = datagrams.columns
    rows = datagrams.where(fits).selectExpr("*", f"{framing.header_bytes} AS p0", "length(payload) AS size")
    for i in range(UNROLLED_SETS):
        rows = rows.selectExpr("*", f"{_u(f'p{i}', 2)} AS id{i}", f"{_u(f'p{i} + 2', 2)} AS n{i}")
        # the position of the next set; null once the message has ended or looks broken
        lowest = 2 if framing.enterprise else 0
        plain = f"size - p{i} > 4 AND n{i} >= 4 AND n{i} <= size - p{i} AND (id{i} >= {lowest} OR n{i} <= 8)"
        rows = rows.selectExpr("*", f"IF({plain}, p{i} + n{i}, CAST(NULL AS INT)) AS p{i + 1}")
    steps = range(UNROLLED_SETS)
    ends = [f"size - p{i} <= 4" for i in range(UNROLLED_SETS + 1)]
    read = ", ".join(f"named_struct('set_id', id{i}, 'off', p{i} + 4, 'len', n{i} - 4)" for i in steps)
    count = " + ".join(f"IF(p{i + 1} IS NOT NULL, 1, 0)" for i in steps)
    zero = (
        f"named_struct('pos', {framing.header_bytes}, 'done', size - {framing.header_bytes} <= 4, "
        f"'error', CAST(NULL AS STRING), 'sets', CAST(array() AS array<{SET}>))"
    )
    simple = (
        f"named_struct('error', CAST(NULL AS STRING), 'sets', CAST(slice(array({read}), 1, {count}) AS array<{SET}>))"
    )
    staged = rows.selectExpr(*columns, f"IF({' OR '.join(ends)}, {simple}, NULL) AS w0", "size")
    first = staged.selectExpr(*columns, "w0", f"IF(w0 IS NOT NULL, NULL, {_set_walk(framing, '64', zero)}) AS w1")
    rest = f"IF(w1.done, w1, {_set_walk(framing, 'greatest(1, length(payload) div 4)', 'w1')})"
    walked = first.selectExpr(*columns, "w0", f"IF(w0 IS NOT NULL, NULL, {rest}) AS w2").selectExpr(
        *columns,
        "named_struct('error', coalesce(w0.error, w2.error), 'sets', coalesce(w0.sets, w2.sets)) AS walk",
    )
    return settle(walked, "walk")


def _keep(frame: DataFrame) -> list[str]:
    return [c for c in ("agent", "domain", "recv_ts", "msg_id") if c in frame.columns]


def sets_of(datagrams: DataFrame, framing: Framing) -> DataFrame:
    """One row per set: ``set_ix, set_id, body`` and the message's framing error."""
    rows = walked_messages(datagrams, framing)
    keep = _keep(rows)
    return rows.selectExpr(
        *keep, "payload", "walk.error AS message_error", "posexplode(walk.sets) AS (set_ix, s)"
    ).selectExpr(
        *keep, "set_ix", "s.set_id AS set_id", "substring(payload, s.off + 1, s.len) AS body", "message_error"
    )


# ------------------------------------------------------------------ template walk


def _announced(rows: DataFrame, framing: Framing, columns: list[str]) -> DataFrame:
    """``columns`` of messages with ``payload`` and ``sets``, their ``templates``, and ``template_error`` where one is cut short.

    Whole Arrow batches are read at once, as a fold in a lambda takes some 100 microseconds for a template. Rows stay where they are.
    """
    added = [("templates", TEMPLATES), ("template_error", "string")]
    kept = [f for f in rows.schema.fields if f.name in columns]
    schema = T.StructType([*sorted(kept, key=lambda f: columns.index(f.name)), *(T.StructField(n, T.DataType.fromDDL(k)) for n, k in added)])
    names, form = [*columns, *(n for n, _ in added)], (framing.template_set, framing.option_set, framing.enterprise)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            templates, error = read_announced(batch.column("payload"), batch.column("sets"), *form)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), templates, error], names)

    return rows.mapInArrow(run, schema)


def template_records(datagrams: DataFrame, framing: Framing) -> DataFrame:
    """One row per announced template, option templates included, in announcement order."""
    rows = walked_messages(datagrams, framing)
    keep = _keep(rows)
    announces = f"exists(walk.sets, s -> s.set_id IN ({framing.template_set}, {framing.option_set}))"
    found = _announced(rows.where(announces).selectExpr(*keep, "payload", "walk.sets AS sets"), framing, keep)
    return found.selectExpr(*keep, "explode(templates) AS t").selectExpr(
        *keep,
        "t.set_ix AS set_ix",
        "t.rec_ix AS rec_ix",
        f"t.set_id = {framing.option_set} AS is_option",
        "t.template_id AS template_id",
        "size(filter(t.fields, f -> f.scope)) AS scope_count",
        "t.fields AS fields",
    )


def _checked_messages(datagrams: DataFrame, framing: Framing, read: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """Messages with their ``message_error`` and the columns ``read``, and the columns that identify and describe a message."""
    rows = walked_messages(datagrams, framing)
    keep = _keep(rows)
    names = [*keep, *(c for c in rows.columns if c not in (*keep, "payload", "walk", "proto"))]
    framed = rows.selectExpr(*names, "payload", "walk.sets AS sets", "walk.error AS framing_error")
    checked = _announced(framed, framing, [*names, *read, "framing_error"])
    return checked.selectExpr(*names, *read, "coalesce(framing_error, template_error) AS message_error"), names


def message_errors(datagrams: DataFrame, framing: Framing) -> DataFrame:
    """Messages whose framing or templates are broken, with the reason, whether or not they hold data sets."""
    checked, names = _checked_messages(datagrams, framing)
    return checked.where("message_error IS NOT NULL").select(*names, "message_error")


def data_sets(datagrams: DataFrame, framing: Framing) -> DataFrame:
    """One row per data set: ``set_ix, template_id, body, message_error``.

    ``message_error`` is set where framing or a template of the message is broken.
    """
    checked, names = _checked_messages(datagrams, framing, ("payload", "sets"))
    return (
        checked.selectExpr(*names, "payload", "message_error", "posexplode(sets) AS (set_ix, s)")
        .where("s.set_id > 255")
        .selectExpr(
            *names, "set_ix", "s.set_id AS template_id", "substring(payload, s.off + 1, s.len) AS body", "message_error"
        )
    )


# ------------------------------------------------------------------ registry


def _position(order: list[str]) -> Column:
    return F.struct(*order)


def template_registry(announcements: DataFrame, keys: tuple[str, ...] = ("agent",)) -> DataFrame:
    """The newest template per (agent, id). Partial aggregates run before the shuffle."""
    others = [c for c in announcements.columns if c not in (*keys, "template_id")]
    newest = F.max_by(F.struct(*others), F.struct(*ORDER, "rec_ix"))
    return (
        announcements.groupBy(*keys, "template_id").agg(newest.alias("t")).select(*keys, "template_id", "t.*")
    )


def known_template_ids(registry: DataFrame) -> DataFrame:
    """All known ids in order; an id shows once per agent that uses it."""
    return registry.select("template_id").orderBy("template_id")


def template_versions(
    announcements: DataFrame, keys: tuple[str, ...] = ("agent",), bucket: str = "hour", content: str = "fields"
) -> DataFrame:
    """Change points: every template with the stretch of positions in which it is valid.

    ``content`` is the column that makes a version: the fields, or ``layout``, their digest (:func:`with_layout`), which is less to move.

    Exporters repeat their templates all the time, and some change them all the time. Repeats are dropped inside (agent, id, time
    bucket) against the row before, which for the first row of a bucket is the last one of the bucket before; where a
    version ends is found likewise. So no task sees more of one template than a bucket, or one row per bucket. ``valid_to`` is
    null for the newest.
    """
    key = [*keys, "template_id"]
    near = Window.partitionBy(*key, "bucket").orderBy("valid_from", "rec_ix")
    rows = announcements.select(*key, _position(ORDER).alias("valid_from"), "rec_ix", content, F.date_trunc(bucket, "recv_ts").alias("bucket"))
    same = F.coalesce(F.lag(content).over(near) == F.col(content), F.lit(False))
    changes = with_edges(rows, key, "bucket", ["valid_from", "rec_ix"]).withColumn("same", same).where("NOT same AND NOT edge").drop("same", "edge")
    ends = with_edges(changes, key, "bucket", ["valid_from", "rec_ix"], after=True)
    versions = ends.withColumn("valid_to", F.lead("valid_from").over(near)).where("NOT edge")
    # of two templates for one id in one set only the last can apply
    versions = versions.where(F.col("valid_to").isNull() | (F.col("valid_from") < F.col("valid_to")))
    return versions.select(*key, "valid_from", content, "valid_to")


def with_layout(announced: DataFrame) -> DataFrame:
    """Announcements or versions with the digest of their fields, ``layout``."""
    return announced.withColumn("layout", F.md5(F.to_json("fields").cast("binary")))


def layouts(announced: DataFrame, elements: DataFrame, enterprise: bool = True) -> DataFrame:
    """The dictionary of different field lists, by ``layout``, with each field's place in the record and how to read it.

    Exporters of one kind announce the same field lists, so this has far fewer rows than there are versions. A lookup join with
    the (small, driver-made) elements and one grouping per field list, which is bounded by the size of a datagram. v9 looks
    every id up under enterprise 0.
    """
    lists = announced.select("layout", "fields").dropDuplicates(["layout"])
    rows = lists.select("layout", F.posexplode_outer("fields").alias("ix", "f")).select("layout", "ix", "f.*")
    names = elements.select(
        F.col("enterprise").alias("x_enterprise"), F.col("element_id").alias("x_id"), "name", F.col("type").alias("type_name")
    )
    number = F.col("enterprise") if enterprise else F.lit(0)
    typed = rows.join(F.broadcast(names), (F.col("x_enterprise") == number) & (F.col("x_id") == F.col("element_id")), "left")
    kind, width = kind_of(F.col("type_name")), width_of(F.col("type_name"))
    stretchy = (F.col("length") == 65535) & kind.isin("text", "bytes") if enterprise else F.lit(False)
    field = F.struct(
        "ix", "element_id", "length", "enterprise", "scope", kind.alias("kind"), width.alias("width"),
        F.coalesce(stretchy, F.lit(False)).alias("variable"),
    )
    grouped = typed.groupBy("layout").agg(
        F.array_sort(F.collect_list(F.when(F.col("ix").isNotNull(), field))).alias("fields"),
        F.sum(F.when(stretchy, 1).otherwise(F.col("length"))).cast("int").alias("record_bytes"),
        F.coalesce(F.max(stretchy), F.lit(False)).alias("variable"),
        F.min(F.when(F.col("ix").isNotNull() & F.col("name").isNull(), F.struct("ix", "element_id")))["element_id"].alias("unknown_element"),
    )
    placed = F.transform(
        "fields",
        lambda f, i: f.withField(
            "off", F.aggregate(F.slice("fields", F.lit(1), i), F.lit(0), lambda n, g: n + g["length"])
        ),
    )
    return grouped.withColumn("fields", placed)


#: Rows of a relation (some 100 bytes each) up to which it is broadcast.
BROADCAST_ROWS = 500_000
#: Versions of one template that share a slot, on average.
SLOT = 4


def hinted(rows: int, *frames: DataFrame) -> list[DataFrame]:
    """The frames, marked for broadcast where so many rows are few; else they are joined by a shuffle."""
    return [F.broadcast(frame) if rows <= BROADCAST_ROWS else frame for frame in frames]


def version_slots(versions: DataFrame, keys: tuple[str, ...] = ("agent",)) -> tuple[DataFrame, DataFrame]:
    """The stretch of positions of each template cut into slots, and the versions once for each slot that they reach into.

    First: template, ``begins``, ``wide`` and ``slots``; second: the versions with ``slot``. A template with ``SLOT`` changes or less
    is one slot. One that flaps has slots in proportion to its changes, so a set meets a few versions however many there
    are; slots are of even width in time (in message number where all changes come at one time).
    """
    place = F.unix_micros(F.col("valid_from.recv_ts"))
    over = [*keys, "template_id"]
    spans = versions.groupBy(*over).agg(
        F.count("*").alias("n"), F.min(place).alias("t0"), F.max(place).alias("t1"),
        F.min("valid_from.msg_id").alias("m0"), F.max("valid_from.msg_id").alias("m1"),
    )
    timed = F.col("t1") > F.col("t0")
    slots = F.greatest(F.lit(1), F.floor((F.col("n") - 1) / SLOT))
    begins, ends = F.when(timed, F.col("t0")).otherwise(F.col("m0")), F.when(timed, F.col("t1")).otherwise(F.col("m1"))
    spans = spans.select(
        *over, timed.alias("timed"), begins.alias("begins"), (F.floor((ends - begins) / slots) + 1).alias("wide"), slots.alias("slots")
    )
    joined = versions.join(spans, over)
    reach = F.when(F.col("valid_to").isNull(), F.col("slots") - 1).otherwise(slot_of(F.col("valid_to.recv_ts"), F.col("valid_to.msg_id")))
    slot = F.explode(F.sequence(slot_of(F.col("valid_from.recv_ts"), F.col("valid_from.msg_id")), reach))
    return spans, joined.select(*versions.columns, slot.alias("slot"))


def slot_of(recv_ts: Column, msg_id: Column) -> Column:
    """The slot of a position, by the columns of :func:`version_slots`."""
    at = F.when(F.col("timed"), F.unix_micros(recv_ts)).otherwise(msg_id)
    return F.least(F.greatest(F.expr("0L"), F.floor((at - F.col("begins")) / F.col("wide"))), F.col("slots") - 1)


def resolve_templates(sets: DataFrame, versions: DataFrame, keys: tuple[str, ...] = ("agent",)) -> DataFrame:
    """Every data set with the template that was valid when it came in (null if none was).

    Two equi joins, on the template and on (template, slot), whose residual picks the one version covering the set's position.
    Versions should be stored (:func:`flowlake.session.stored`): they are counted, and where they are few both are broadcast and no
    set moves; else sets are dealt by (template, slot), which spreads one that flaps. There are no more slots than versions,
    and at most two rows of the second relation for each version and slot. No window over the sets, and no pairs of all sets
    with all versions.
    """
    spans, slotted = hinted(versions.count(), *version_slots(versions, keys))
    over = [*keys, "template_id"]
    marked = sets.join(spans, over, "left").withColumn("slot", slot_of(F.col("recv_ts"), F.col("msg_id"))).select(*sets.columns, "slot")
    same = [F.col(f"s.{c}") == F.col(f"v.{c}") for c in (*over, "slot")]
    position = F.struct(*[F.col(f"s.{c}") for c in ORDER])
    covers = (position > F.col("v.valid_from")) & (F.col("v.valid_to").isNull() | (position <= F.col("v.valid_to")))
    extra = [F.col(f"v.{c}") for c in versions.columns if c not in over]
    condition = covers
    for one in same:
        condition &= one
    return marked.alias("s").join(slotted.alias("v"), condition, "left").select(*[F.col(f"s.{c}") for c in sets.columns], *extra)


def name_elements(fields: DataFrame, elements: DataFrame) -> DataFrame:
    """Field rows (``element_id, enterprise``) with ``name`` and ``type``; null where unknown."""
    return fields.join(elements, ["enterprise", "element_id"], "left")


def unknown_elements(fields: DataFrame, elements: DataFrame) -> DataFrame:
    """How often each element that the dictionary lacks was seen."""
    missing = fields.join(elements, ["enterprise", "element_id"], "left_anti")
    return missing.groupBy("enterprise", "element_id").agg(F.count("*").alias("n"))
