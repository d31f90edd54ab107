"""Structured Streaming jobs. The transformations are those of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowlake.operators import flows as fl
from flowlake.operators import messages as m
from flowlake.operators.metrics import COUNTERS, collector_counters, message_rate
from flowlake.sources import sinks


def flow_stream(lines: DataFrame, proto: str = "ipfix", profile: str = "full") -> DataFrame:
    """JSON lines to flow rows; stateless, so it is the same for batch and stream."""
    return fl.pivot_flow(m.explode_records(m.export_timestamp(m.parse_messages(lines, proto), proto)), profile)


def start(frame: DataFrame, checkpoint: str, trigger: str | None = "20 seconds", sink=None, path: str | None = None, fmt: str = "parquet", mode: str = "append") -> StreamingQuery:
    """Run a stream into a batch function ``sink(df, epoch)`` or a file sink.

    ``trigger=None`` takes what is there and stops.
    """
    writer = frame.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if trigger is None else writer.trigger(processingTime=trigger)
    if sink is not None:
        return writer.foreachBatch(sink).start()
    return writer.format(fmt).option("path", path).start()


def stream_ingest(lines: DataFrame, path: str, checkpoint: str, proto: str = "ipfix", profile: str = "full", trigger: str | None = "20 seconds") -> StreamingQuery:
    """Topic to flow table in 20-second batches. The file sink's log makes each batch count once."""
    return start(flow_stream(lines, proto, profile), checkpoint, trigger, path=path)


def stream_append(
    flows: DataFrame, path: str, checkpoint: str, name: str, table: str | None = None, fmt: str = "parquet",
    layout: str | None = None, trigger: str | None = "20 seconds",
) -> StreamingQuery:
    """Flow rows to a table that other jobs write and read as well. ``name`` and the batch number make each batch count once."""

    def append(batch: DataFrame, epoch: int) -> None:
        sinks.append_flows(batch, path, fmt, layout, table, batch=f"{name}-{epoch}")

    return start(flows, checkpoint, trigger, sink=append)


def stream_counters(log: DataFrame, path: str, checkpoint: str, trigger: str | None = "20 seconds") -> StreamingQuery:
    """Collector counters of each batch of received datagrams, in a folder of its number, overwritten when it is repeated.

    Counters need no state: :func:`total_counters` adds the batches up.
    """

    def count(batch: DataFrame, epoch: int) -> None:
        collector_counters(batch).write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return start(log, checkpoint, trigger, sink=count)


def total_counters(counted: DataFrame) -> DataFrame:
    """The counters so far, of what :func:`stream_counters` wrote."""
    sums = [F.sum(f"{name}_count").alias(f"{name}_count") for name in COUNTERS]
    return counted.groupBy("host", "proto").agg(*sums)


def stream_rates(messages: DataFrame, window: str = "10 seconds", lateness: str = "1 minute", time: str = "ts", partition: str = "partition") -> DataFrame:
    """Message rates on a stream; a window closes once the watermark has passed it."""
    return message_rate(messages.withWatermark(time, lateness), window, time, partition)


def latest_rates(rates: DataFrame, partition: str = "partition") -> DataFrame:
    """The last state of each window of rates that were written in update mode."""
    return rates.groupBy("window_start", partition).agg(F.max("n").alias("n"), F.max("rate").alias("rate"))


def stream_match_element(lines: DataFrame, element_id: int = 12, value: str = "", proto: str = "ipfix") -> DataFrame:
    """Records with a matching field, once per match."""
    return fl.match_element(m.explode_records(m.parse_messages(lines, proto)), element_id, value, multiplicity=True)


def stream_tee_raw(datagrams: DataFrame, path: str, checkpoint: str, trigger: str | None = "20 seconds") -> StreamingQuery:
    """Copy every raw datagram to the folder of its address family.

    A batch goes to a folder of its own number, overwritten when the batch is repeated, so that a
    restart leaves no second copy.
    """

    def copy(batch: DataFrame, epoch: int) -> None:
        sinks.tee_raw(batch, f"{path}/batch={epoch}", mode="overwrite")

    return start(datagrams, checkpoint, trigger, sink=copy)
