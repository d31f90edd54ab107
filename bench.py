"""Benchmark: ``BENCH_SF_DIR`` (default sf0.1) on ``local[BENCH_CPUS]``; one JSON line on stdout.

Inputs (JSON lines, datagrams) are written once outside of the timing, as a collector would
leave them; each query then runs from those files to a sink that takes every row.
"""

from __future__ import annotations

import json
import os
import pathlib
import sys
import time
import uuid

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

from pyspark.sql import DataFrame  # noqa: E402

from flowlake.operators import flows as fl  # noqa: E402
from flowlake.operators import ipfix as ix  # noqa: E402
from flowlake.operators import messages as m  # noqa: E402
from flowlake.operators import metrics as mt  # noqa: E402
from flowlake.operators import netflow5 as n5  # noqa: E402
from flowlake.operators import netflow9 as n9  # noqa: E402
from flowlake.operators import records as r  # noqa: E402
from flowlake.operators import sflow as sf  # noqa: E402
from flowlake.operators import templates as t  # noqa: E402
from flowlake.plans import fixtures as fx  # noqa: E402
from flowlake.session import local_session, shared_folder  # noqa: E402


def drain(frame: DataFrame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus), memory=os.environ.get("BENCH_MEMORY", "12g"))
    folder = f"{shared_folder(spark)}/bench-{uuid.uuid4().hex}"

    staged = {
        "json": fx.line_json,
        "netflow5": fx.netflow5_datagrams,
        "ipfix": fx.ipfix_datagrams,
        "netflow9": fx.netflow9_datagrams,
        "sflow": fx.sflow_datagrams,
        "log": fx.datagram_log,
    }
    tables, counts = {}, {}
    for name, build in staged.items():
        build(spark, sf_dir).write.parquet(f"{folder}/{name}")
        tables[name] = spark.read.parquet(f"{folder}/{name}")
        counts[name] = tables[name].count()
    elements = fx.element_dictionary(spark)

    def wide(lines: DataFrame) -> DataFrame:
        return fl.pivot_flow(m.explode_records(m.export_timestamp(m.parse_messages(lines))))

    wide(tables["json"]).write.parquet(f"{folder}/flows")
    tables["flows"] = spark.read.parquet(f"{folder}/flows")
    counts["flows"] = tables["flows"].count()

    runs = {
        "json_to_flow_table": ("json", lambda: wide(tables["json"])),
        "json_top_flows": ("json", lambda: fl.top_flows(wide(tables["json"]))),
        "netflow5_flows": ("netflow5", lambda: n5.netflow5_table(tables["netflow5"])),
        "template_registry": ("ipfix", lambda: t.template_registry(ix.template_table(tables["ipfix"]))),
        "ipfix_flow_table": ("ipfix", lambda: r.flow_table(tables["ipfix"], t.IPFIX, elements)),
        "ipfix_records": ("ipfix", lambda: ix.ipfix_table(tables["ipfix"], elements)),
        "netflow9_records": ("netflow9", lambda: n9.netflow9_table(tables["netflow9"], elements)),
        "sflow_packets": ("sflow", lambda: sf.sflow_packet_table(tables["sflow"])),
        "sflow_counters_generic": ("sflow", lambda: sf.sflow_counter_table(tables["sflow"], "generic")),
        "message_rate": ("log", lambda: mt.message_rate(tables["log"])),
        "stored_top_flows": ("flows", lambda: fl.top_flows(tables["flows"])),
        "decode_report": ("ipfix", lambda: ix.ipfix_report(tables["ipfix"], elements)),
        "resolve_templates": (
            "ipfix",
            lambda: t.resolve_templates(t.data_sets(tables["ipfix"], t.IPFIX), t.template_versions(ix.template_table(tables["ipfix"]))),
        ),
    }
    times, rates, rows = {}, {}, {}
    for name, (source, build) in runs.items():
        best = None
        for _ in range(2):
            began = time.perf_counter()
            drain(build())
            took = time.perf_counter() - began
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
        rates[name] = round(counts[source] / best)
        rows[name] = round(build().count() / best)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "messages_per_second": rates,
                "rows_out_per_second": rows,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
