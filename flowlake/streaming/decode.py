"""Decoding streams: datagrams to records, with templates and waiting sets carried from batch to batch as tables.

A micro-batch decodes with the templates that it announces and those of the batches before it, as the batch operators do. State is
two tables, each in two folders that alternate: batch n reads what batch n - 1 wrote and overwrites what n - 2 wrote, so a
batch that is repeated after a failure finds its state unchanged, and its output, in a folder of its number, is overwritten.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowlake.operators import netflow5, sflow
from flowlake.operators import records as r
from flowlake.operators import templates as t
from flowlake.operators.replay import replay, waiting_sets
from flowlake.operators.templates import Framing
from flowlake.session import stored
from flowlake.streaming.jobs import start


def _state(like: DataFrame, folder: str, epoch: int, initial: DataFrame | None) -> DataFrame | None:
    """What the batch before ``epoch`` left, else ``initial``."""
    try:
        return like.sparkSession.read.parquet(f"{folder}/{(epoch - 1) % 2}") if epoch else initial
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):  # state was not kept so far
            return initial
        raise


def stream_records(
    datagrams: DataFrame,
    framing: Framing,
    elements: DataFrame,
    path: str,
    checkpoint: str,
    registry: DataFrame | None = None,
    max_age: str | None = None,
    trigger: str | None = "20 seconds",
    reduced_size: str = "hex",
    on_error: str = "drop_message",
    on_unknown: str = "drop_set",
) -> StreamingQuery:
    """Datagrams of a template protocol to records, below ``path``/records, a folder for each batch.

    ``registry`` holds templates known at the start (:func:`flowlake.sources.sinks.load_templates`). Rows with a ``domain``
    (:func:`flowlake.operators.records.with_domain`) have templates by domain. With ``max_age`` sets that come before their template wait for it
    so long; their records go to ``path``/replayed, and sets that never give any to ``path``/verdicts.
    """

    def decode(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        before = _state(batch, f"{path}/templates", epoch, registry)
        known = r.versions_and_layouts(batch, framing, elements, before)
        status = r.judged_sets(batch, framing, *known, on_unknown, again=on_error == "drop_message" or max_age is not None)
        records = r.slice_records(r.usable_sets(status, framing, on_error), reduced_size)
        records.write.mode("overwrite").parquet(f"{path}/records/batch={epoch}")
        announced = stored(r.announcements(batch, framing, before))
        if max_age is not None:
            waiting = waiting_sets(status)
            earlier = _state(batch, f"{path}/waiting", epoch, None)
            waiting = stored(waiting if earlier is None else waiting.unionByName(earlier))
            now = F.lit(batch.agg(F.max("recv_ts")).first()[0])
            done = replay(waiting, announced, framing, elements, now, max_age, reduced_size, on_unknown)
            done.records.write.mode("overwrite").parquet(f"{path}/replayed/batch={epoch}")
            done.verdicts.write.mode("overwrite").parquet(f"{path}/verdicts/batch={epoch}")
            done.waiting.write.mode("overwrite").parquet(f"{path}/waiting/{epoch % 2}")
        latest = t.template_registry(announced, r.keys_of(batch)).select(*announced.columns)
        latest.write.mode("overwrite").parquet(f"{path}/templates/{epoch % 2}")
        batch.unpersist()

    return start(datagrams, checkpoint, trigger, sink=decode)


def stream_netflow5_flows(datagrams: DataFrame, path: str, checkpoint: str, trigger: str | None = "20 seconds") -> StreamingQuery:
    """NetFlow v5 datagrams to flows; stateless, so the plan is that of the batch job."""
    return start(netflow5.netflow5_table(datagrams), checkpoint, trigger, path=path)


def stream_sflow_packets(
    datagrams: DataFrame, path: str, checkpoint: str, exclude_types: list[int] | None = None, trigger: str | None = "20 seconds"
) -> StreamingQuery:
    """sFlow datagrams to sampled packets; stateless, so the plan is that of the batch job."""
    return start(sflow.sflow_packet_table(datagrams, exclude_types), checkpoint, trigger, path=path)
