"""Collector counters: totals, rates, gauges, and their long and text forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlake.operators.buckets import with_edges

# Metric name, statistics column, kind.
METRICS = [
    ("udp.rate", "udp_rate", "rate"),
    ("decode.rate", "decode_rate", "rate"),
    ("mq.error.rate", "mq_error_rate", "rate"),
    ("workers", "workers", "gauge"),
    ("udp.queue", "udp_queue", "gauge"),
    ("mq.queue", "message_queue", "gauge"),
    ("udp.mirror.queue", "udp_mirror_queue", "gauge"),
]
# Metric name, statistics column.
SYSTEM_METRICS = [
    ("mem.heap.alloc", "MemHeapAlloc"),
    ("mem.alloc", "MemAlloc"),
    ("mcache.inuse", "MCacheInuse"),
    ("mem.total.alloc", "MemTotalAlloc"),
    ("mem.heap.sys", "MemHeapSys"),
    ("num.goroutine", "NumGoroutine"),
]
# Exposed series, statistics column.
SERIES = [
    ("decoded_packets", "decoded_count"),
    ("mq_error", "mq_error_count"),
    ("udp_packets", "udp_count"),
    ("message_queue", "message_queue"),
    ("udp_queue", "udp_queue"),
    ("workers", "workers"),
    ("udp_mirror_queue", "udp_mirror_queue"),
]


#: Counters of a poll, each in a column ``<name>_count``.
COUNTERS = ["udp", "decoded", "mq_error"]


def collector_counters(log: DataFrame) -> DataFrame:
    """Received, decoded and publish errors per host and protocol (map-side partial counts)."""
    return log.groupBy("host", "proto").agg(
        F.count("*").alias("udp_count"),
        F.count_if("decoded").alias("decoded_count"),
        F.count_if("publish_error").alias("mq_error_count"),
    )


def counter_rates(stats: DataFrame, bucket: str = "day") -> DataFrame:
    """Per-second rates between one poll and the one before it, by whole-number division.

    A rate needs an earlier poll of the same run: the history is per (host, protocol, start of the run), which makes the first
    poll and a restart null. It is cut into time buckets, so a run that never ends spreads over tasks. No time between the
    polls, or a counter that fell, is null too. Polls at one time follow each other by their counts.
    """
    run, order = ["host", "proto", "start_time"], ["ts", *[f"{name}_count" for name in COUNTERS]]
    rows = stats.select("*", F.date_trunc(bucket, "ts").alias("_bucket"))
    rows = with_edges(rows, run, "_bucket", order)
    near = Window.partitionBy(*run, "_bucket").orderBy(F.col("edge").desc(), *order)
    gap = F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(near))
    rows = rows.withColumn("gap", gap).withColumns(
        {f"{name}_gain": F.col(f"{name}_count") - F.lag(f"{name}_count").over(near) for name in COUNTERS}
    ).where("NOT edge")

    def rate(name: str):
        usable = (F.col("gap") > 0) & (F.col(f"{name}_gain") >= 0)
        return F.when(usable, F.expr(f"{name}_gain div gap"))

    return rows.select(
        *stats.columns,
        rate("udp").alias("udp_rate"),
        rate("decoded").alias("decode_rate"),
        rate("mq_error").alias("mq_error_rate"),
    )


def message_rate(messages: DataFrame, window: str = "10 seconds", time: str = "ts", partition: str = "partition") -> DataFrame:
    """Messages per second and partition, averaged over tumbling windows (whole numbers)."""
    seconds = int(window.split()[0]) * {"second": 1, "minute": 60, "hour": 3600}[window.split()[1].rstrip("s")]
    counted = messages.groupBy(F.window(time, window).alias("w"), partition).agg(F.count("*").alias("n"))
    return counted.select(
        F.col("w.start").alias("window_start"), partition, "n", F.expr(f"n div {seconds}").alias("rate")
    )


GAUGES = ["udp_queue", "message_queue", "udp_mirror_queue", "workers"]


def gauges_latest(stats: DataFrame) -> DataFrame:
    """The newest gauge values per host and protocol (a partial aggregate, no window)."""
    newest = F.max_by(F.struct("ts", *GAUGES), F.col("ts"))
    return stats.groupBy("host", "proto").agg(newest.alias("g")).select("host", "proto", "g.*")


def metrics_long(rates: DataFrame) -> DataFrame:
    """One row per (metric, type, host, time): rates and gauges of every protocol.

    The mirror queue exists for IPFIX only; other missing values stay out.
    """
    pairs = ", ".join(f"'{metric}', CAST({column} AS BIGINT)" for metric, column, _ in METRICS)
    return rates.selectExpr("host", "proto AS type", "ts", f"stack({len(METRICS)}, {pairs}) AS (metric, value)").where(
        "value IS NOT NULL"
    )


def system_metrics_long(system: DataFrame) -> DataFrame:
    """Process statistics (one column each) as (metric, host, value) rows."""
    pairs = ", ".join(f"'{metric}', CAST({column} AS BIGINT)" for metric, column in SYSTEM_METRICS)
    return system.selectExpr("host", "ts", f"stack({len(SYSTEM_METRICS)}, {pairs}) AS (metric, value)")


def counter_names(stats: DataFrame, prefix: str = "flowlake") -> DataFrame:
    """Exposed series: ``<prefix>_<protocol>_<metric>`` with the current value per host."""
    pairs = ", ".join(f"'{name}', CAST({column} AS BIGINT)" for name, column in SERIES)
    columns = [column for _, column in SERIES]
    newest = stats.groupBy("host", "proto").agg(F.max_by(F.struct(*columns), F.col("ts")).alias("s"))
    rows = newest.select("host", "proto", "s.*").selectExpr("host", "proto", f"stack({len(SERIES)}, {pairs}) AS (name, value)")
    return rows.where("value IS NOT NULL").select("host", F.concat_ws("_", F.lit(prefix), "proto", "name").alias("series"), "value")


def metric_lines(metrics: DataFrame) -> DataFrame:
    """Text lines ``metric,type=…,host=… value=n`` (no type for system metrics)."""
    has_type = "type" in metrics.columns
    tag = F.concat(F.lit(",type="), F.col("type")) if has_type else F.lit("")
    return metrics.select(
        F.concat("metric", tag, F.lit(",host="), "host", F.lit(" value="), F.col("value").cast("string")).alias("value")
    )


def metric_points_json(metrics: DataFrame) -> DataFrame:
    """JSON points ``{"metric":…,"timestamp":…,"value":…,"tags":{"host":…,"type":…}}``."""
    kind = F.col("type") if "type" in metrics.columns else F.lit("")
    point = F.struct(
        "metric",
        F.unix_timestamp("ts").alias("timestamp"),
        "value",
        F.struct("host", kind.alias("type")).alias("tags"),
    )
    return metrics.select(F.to_json(point).alias("value"))
