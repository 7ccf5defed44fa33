"""Headline queries, timed. Prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from gridrank.plans import views
from gridrank.plans.pagerank import pagerank
from gridrank.plans.queries import QUERIES
from gridrank.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ["spmv_kv", "spmv_block_join", "csr_trans_mult", "matmul", "row_normalize", "degree_hist", "block_nnz", "downsample_2d", "reorder_rows_by_sum", "format_cost_sweep", "mm_read"]


def main() -> None:
    spark = local_session(cores=CPUS, partitions=int(CPUS))
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["row_sums"](spark, SF_DIR).write.format("noop").mode("overwrite").save()  # starts what every query needs
    seconds = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
    n = views.n_parts(spark, SF_DIR)
    found = pagerank(views.part_dag(spark, SF_DIR), n, tolerance=None, most_rounds=10)
    seconds["pagerank_10_rounds"] = round(found.seconds, 3)
    seconds["pagerank_round"] = round(sum(h[3] for h in found.history) / len(found.history), 3)
    total = sum(v for k, v in seconds.items() if k != "pagerank_round")
    sf = os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(total, 3), "unit": "sec", "queries": seconds, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
