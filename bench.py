"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line: {"metric", "value", "unit", "queries", "sf"}.
Each query is fully executed with the ``noop`` sink (no driver collect).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "recommend_users",          # flagship: events, all users
    "recommend_users_orders",   # sparse, large: order lines
    "recommend_requests",
    "user_similarity",
    "popular_top8",
    "catalog_enriched",
    "catalog_filter",
    "tokens_clean",
    "doc_vectors",
    "similar_products",
    "chat_answer",
    "retrieve_top3",
    "call_gap_audit",
    "stream_matrix",
    "phrase_bigrams",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    from pyspark.sql import functions as F

    from vitrine.plans.registry import QUERIES
    from vitrine.session import build_session

    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    # warm-up of the JVM and of the Python workers (no test data touched)
    spark.range(1000).selectExpr("sum(id)").collect()
    n = int(cpus) * 2
    (spark.range(0, 100 * n, 1, n).withColumn("g", F.col("id") % n).groupBy("g")
     .applyInPandas(lambda pdf: pdf.head(1), "id long, g long").collect())
    times = {}
    for n in names:
        t0 = time.time()
        QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.time() - t0, 3)
        print(f"# {n}: {times[n]} s", file=sys.stderr, flush=True)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
