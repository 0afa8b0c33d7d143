"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the local threads.
``queries`` holds each query's first run in the session, plan building and Python start-up included;
``warm`` its second run.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quantaloom.plans import catalog  # noqa: E402
from quantaloom.session import local_session  # noqa: E402

HEADLINE = [
    "core_metrics",
    "bucket_stats",
    "domain_metrics",
    "marginal_metrics",
    "top_buckets",
    "bucket_purity",
    "bucket_jaccard",
    "rebuild_text_format",
    "record_packed_code",
    "format_b_records",
    "value_distribution",
    "strict_positional_join",
    "patch_layer5",
    "row_numbers",
    "encode_two_levels",
    "bucket_cosine",
    "item_cosine",
    "dedup_vectors",
    "seeded_sample",
    "residual_training",
    "balanced_assignment",
    "batch_balanced_codes",
    "ema_update",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = os.environ.get("BENCH_ONLY")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()
    first, warm = {}, {}
    for name in only.split(",") if only else HEADLINE:
        for seconds in (first, warm):
            start = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(first.values()), 3),
                "unit": "sec",
                "queries": first,
                "warm": warm,
                "warm_total": round(sum(warm.values()), 3),
                "sf": sf_dir.rsplit("sf", 1)[-1].strip("/"),
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
