"""Data sets that came before their template: kept with header and age, and decoded once the template is announced."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlake.operators import records as r
from flowlake.operators import templates as t
from flowlake.operators.templates import Framing
from flowlake.session import stored


class Replay(NamedTuple):
    """``records`` of sets whose template came; sets that are ``waiting`` on; ``verdicts`` on sets that give no records."""

    records: DataFrame
    waiting: DataFrame
    verdicts: DataFrame


def waiting_sets(status: DataFrame) -> DataFrame:
    """Sets of an unknown template (from :func:`flowlake.operators.records.set_status`), with all that decoding them takes."""
    unknown = status.where("reason = 'unknown template'")
    return unknown.select(*r.keys_of(status), "recv_ts", "msg_id", "Header", "set_ix", "template_id", "body", F.lit(0).alias("attempts"))


def first_announcements(announced: DataFrame, keys: tuple[str, ...] = ("agent",)) -> DataFrame:
    """The first announcement of each template. A set that is unknown came before all of them, so no other can be its next."""
    position = F.struct(*t.ORDER, "rec_ix")
    first = announced.groupBy(*keys, "template_id").agg(F.min_by("fields", position).alias("fields"), F.min(position).alias("p"))
    return first.select(*keys, "template_id", "fields", F.struct(*[f"p.{c}" for c in t.ORDER]).alias("valid_from"))


def replay(
    waiting: DataFrame,
    announced: DataFrame,
    framing: Framing,
    elements: DataFrame,
    now: Column,
    max_age: str = "1 hour",
    reduced_size: str = "hex",
    on_unknown: str = "drop_set",
) -> Replay:
    """Try waiting sets against announcements.

    A set takes the first template that was announced after it, ``max_age`` later at most. One that finds none waits on,
    with one more attempt, until it is older than that at ``now``; then the verdict is "template never came". Sets whose template
    came but that can't be decoded get that reason as verdict. One equi join on (agent, template), with one row for
    each template; it is broadcast where the rows are few.
    """
    keys = r.keys_of(waiting)
    first = stored(t.with_layout(first_announcements(announced, keys)))
    layouts = stored(t.layouts(first, elements, framing.enterprise))
    age = F.expr(f"INTERVAL '{max_age}'")
    known, lists = t.hinted(first.count(), first.drop("fields"), layouts)
    met = waiting.join(known, [*keys, "template_id"], "left")
    later = F.col("valid_from") > F.struct(*t.ORDER)
    found = F.coalesce(later & (F.col("valid_from.recv_ts") <= F.col("recv_ts") + age), F.lit(False))
    typed = met.where(found).join(lists, "layout", "left").withColumn("message_error", F.lit(None).cast("string"))
    status = r.set_status(typed, framing, on_unknown)
    records = r.slice_records(r.usable_sets(status, framing, "keep_sets"), reduced_size)
    rest = met.where(~found).select(*waiting.columns)
    old = F.col("recv_ts") + age < now
    gone = rest.where(old).withColumn("verdict", F.lit("template never came"))
    broken = status.where("reason IS NOT NULL").select(*waiting.columns, F.col("reason").alias("verdict"))
    return Replay(records, rest.where(~old).withColumn("attempts", F.col("attempts") + 1), gone.unionByName(broken))
