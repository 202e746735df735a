"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: prints one JSON line.  value: the sum of medians."""

import json
import os
import statistics
import time

from tidemark.plans.registry import QUERIES
from tidemark.session import session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
#: Query -> warm runs that are timed.
PLAN = {"scan_filter_agg": 5, "map_chain_20": 5, "multi_epoch_filter": 5, "small_pipeline": 5, "count_per_epoch": 3, "join_revenue_by_key": 3, "wordcount_epoch": 3, "epoch_keyed_sum": 3, "tumbling_sum_5": 3, "distinct_per_epoch": 3, "running_counts": 3, "iterate_double_until": 3, "bfs_levels": 1, "pagerank_dangling": 1, "connected_components": 1}


def seconds(spark, f) -> float:
    t = time.perf_counter()
    f(spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t


def main() -> None:
    spark = session("bench", f"local[{CPUS}]", spark_sql_shuffle_partitions=CPUS, spark_ui_enabled="false", spark_ui_showConsoleProgress="false", spark_driver_memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    out = {}
    for name, n in PLAN.items():
        f = QUERIES[name]
        if n > 1:
            seconds(spark, f)  # compiles
        out[name] = round(statistics.median(seconds(spark, f) for _ in range(n)), 4)
    rows = spark.read.parquet(f"{SF_DIR}/lineitem.parquet").count()
    sf = os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "sum of median query seconds", "value": round(sum(out.values()), 4), "unit": "sec", "queries": out, "sf": float(sf) if sf.replace(".", "").isdigit() else sf, "cpus": int(CPUS), "scan_filter_agg_rows_per_s": round(rows / out["scan_filter_agg"])}))
    spark.stop()


if __name__ == "__main__":
    main()
