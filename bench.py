"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = ("tpch_q1", "arith_double", "arith_columns", "agg_sum", "agg_mean", "top_n_smallest", "distinct_all", "group_count", "group_multi_agg", "group_sparse_int", "join_inner", "join_left", "join_group_sort", "csv_types_roundtrip", "parquet_roundtrip", "distinct_first", "filter_compound")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parent}:{os.environ.get('PYTHONPATH', '')}"
    from millrace.session import session

    spark = session("bench", f"local[{cpus}]", spark_sql_shuffle_partitions=cpus, spark_ui_enabled="false", spark_ui_showConsoleProgress="false", spark_driver_memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    from millrace.plans.registry import QUERIES

    took = {}
    for name in HEADLINE:
        times = []
        for _ in range(4):  # the first run compiles
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(min(times[1:]), 4)
    print(json.dumps({"metric": "headline queries, sum of best times", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
