"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR picks the data (default sf0.1), BENCH_CPUS the threads. The tables, one row
group each, are first written anew in as many files as there are threads, so that scans
use all of them. Each query is planned and run to a sink that keeps nothing; the first run
of a query warms the JVM and the second is reported.
"""

from __future__ import annotations

import glob
import json
import os
import time

from netlumen.functions.features import extract_features
from netlumen.operators import flows
from netlumen.plans import inputs
from netlumen.plans.catalog import QUERIES
from netlumen.plans.catalog_flows import MERGE_ORDER
from netlumen.session import build_session, scratch_path

# The operators themselves where the named query only adds rounding for comparison.
DIRECT = {
    "flow_features": lambda s, d: extract_features(inputs.connections(s, d)),
    "merge_partials": lambda s, d: flows.merge_partials(inputs.connections(s, d), MERGE_ORDER),
    "flow_records": lambda s, d: flows.flow_records(flows.segments(inputs.packets(s, d))),
}
# Query -> table whose rows it consumes, for the rows-per-second figure.
HEADLINE = {
    "flow_features": "lineitem", "merge_partials": "lineitem", "flow_records": "events",
    "device_attribution": "events", "ranked_states": "events", "state_timeline": "events",
    "auc_ap": "events", "operating_points": "events", "latency_stats": "lineitem",
    "alert_rollup": "events", "timeline_density": "events", "identity_merge": "customer",
    "topology_links": "customer", "alert_decode": "events", "stream_flow_assembly": "events",
    "packets_to_alerts": "events", "alert_projection": "lineitem",
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", **{
            "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g",
            "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    rows = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count()
            for t in sorted(set(HEADLINE.values()))}
    spread = scratch_path(spark, "bench-tables")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        spark.read.parquet(path).repartition(int(cpus)).write.parquet(f"{spread}/{os.path.basename(path)}")
    seconds, rates = {}, {}
    for name, table in HEADLINE.items():
        for _ in range(2):
            start = time.perf_counter()
            DIRECT.get(name, QUERIES[name])(spark, spread).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
        seconds[name] = round(took, 3)
        rates[name] = round(rows[table] / took)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "rows_per_sec": rates,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                      "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
