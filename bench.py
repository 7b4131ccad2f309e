"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import statistics
import time

from quarry import build_session
from quarry.plans import PLANS

HEADLINE = ["flagship_revenue", "agg_group", "agg_rollup", "join_group", "join_anti", "join_as_of", "win_topn_per_group", "win_frame_rows", "order_status", "stock_level", "delivery_min_order", "new_order_lookup", "payment_balance", "topk", "filter_range", "index_range", "count_distinct", "stream_sessions"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", master=f"local[{cpus}]", shuffle_partitions=int(cpus), spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    out = {}
    for name in HEADLINE:
        runs = []
        for _ in range(4):
            t = time.time()
            PLANS[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - t)
        out[name] = round(statistics.median(runs[1:]), 4)
    print(json.dumps({"metric": "headline_total", "value": round(sum(out.values()), 3), "unit": "sec", "queries": out, "sf": sf.rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
