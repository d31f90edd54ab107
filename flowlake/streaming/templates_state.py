"""Templates as keyed state: resolve data sets while they stream in."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from flowlake.operators import records as r
from flowlake.operators import templates as t
from flowlake.operators.templates import IPFIX, SPECIFIER, Framing

_STATE = (
    "agent array<string>, template_id array<int>, slot array<int>, template array<string>, "
    "held_agent array<string>, held_template_id array<int>, held_slot array<int>, held_until array<bigint>, "
    "recv_ts array<timestamp>, msg_id array<bigint>, set_ix array<int>, body array<binary>"
)
_OUTPUT = (
    "agent string, template_id int, recv_ts timestamp, msg_id bigint, set_ix int, body binary, template string"
)
_COLUMNS = ["agent", "template_id", "recv_ts", "msg_id", "set_ix", "body", "template"]
_KEY = ["agent", "template_id", "slot"]
_ROW = ["recv_ts", "msg_id", "set_ix", "rec_ix", "body", "template"]


def stream_resolve_templates(
    datagrams: DataFrame, framing: Framing = IPFIX, timeout: str = "10 minutes", wait: bool = True, slots: int = 4, groups: int = 2048
) -> DataFrame:
    """Every data set of a stream with the fields of its template.

    State by (agent, template id): the newest template and, with ``wait``, the sets that came before
    any template. They come out once the template is known, or without one (null ``fields``) after
    ``timeout``. Without ``wait`` they come out unresolved at once, as the batch job has them.

    Processing-time timers keep a query running, so ``wait`` belongs to queries with a
    processing-time trigger, not to ones that take what is there and stop.

    One agent may send most of a stream: its sets spread over ``slots`` state keys by message, and
    every (rare) template goes to all of them.

    Keys share ``groups`` states, since a call costs far more than a row. The number holds for the life of a checkpoint.
    """
    milliseconds = int(pd.Timedelta(timeout).total_seconds() * 1000)
    templates = t.template_records(datagrams, framing).select(
        "agent", "template_id", "recv_ts", "msg_id", "set_ix", "rec_ix",
        F.lit(None).cast("binary").alias("body"), F.to_json("fields").alias("template"),
        F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"),
    )
    sets = t.data_sets(r.message_header(datagrams, framing), framing).where("message_error IS NULL").select(
        "agent", "template_id", "recv_ts", "msg_id", "set_ix", F.lit(0).alias("rec_ix"), "body",
        F.lit(None).cast("string").alias("template"), F.pmod(F.xxhash64("msg_id"), F.lit(slots)).cast("int").alias("slot"),
    )

    def resolve(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        current, held, until, out = {}, {}, {}, []
        if state.exists:
            agents, ids, parts, known, *waiting = state.get
            current = dict(zip(zip(agents, ids, parts, strict=True), known, strict=True))
            for agent, template_id, slot, due, *row in zip(*waiting, strict=True):
                held.setdefault((agent, template_id, slot), []).append(tuple(row))
                until[agent, template_id, slot] = due
        now = state.getCurrentProcessingTimeMs() if wait else 0
        rows = {}
        if not state.hasTimedOut:
            for frame in frames:
                for agent, template_id, slot, *row in frame[_KEY + _ROW].itertuples(index=False, name=None):
                    rows.setdefault((agent, template_id, slot), []).append(tuple(row))
        for name, new in rows.items():
            new.sort(key=lambda row: row[:4])
            template, early = current.get(name), held.pop(name, [])
            for recv_ts, msg_id, set_ix, _, body, announced in new:
                if body is None:
                    template = announced
                    out.extend((*name[:2], *row, template) for row in early)
                    early = []
                elif template is None and wait:
                    early.append((recv_ts, msg_id, set_ix, body))
                else:
                    out.append((*name[:2], recv_ts, msg_id, set_ix, body, template))
            if template is not None:
                current[name] = template
            if early:
                held[name], until[name] = early, now + milliseconds
        for name in [name for name in held if until[name] <= now]:
            out.extend((*name[:2], *row, None) for row in held.pop(name))
        names = [list(column) for column in zip(*current, strict=True)] or [[], [], []]
        waiting = [(*name, until[name], *row) for name, kept in held.items() for row in kept]
        waiting = [list(column) for column in zip(*waiting, strict=True)] or [[] for _ in range(8)]
        state.update((*names, list(current.values()), *waiting))
        if held:
            state.setTimeoutDuration(max(1, min(until[name] for name in held) - now))
        if out:
            yield pd.DataFrame(out, columns=_COLUMNS)

    resolved = (
        templates.unionByName(sets)
        .withColumn("group", F.pmod(F.xxhash64(*_KEY), F.lit(groups)).cast("int"))
        .groupBy("group")
        .applyInPandasWithState(
            resolve, _OUTPUT, _STATE, "append",
            GroupStateTimeout.ProcessingTimeTimeout if wait else GroupStateTimeout.NoTimeout,
        )
    )
    return resolved.withColumn("fields", F.from_json("template", f"array<{SPECIFIER}>")).drop("template")
