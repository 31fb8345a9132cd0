"""Headline queries, timed: one JSON line with seconds per query (median of up to three after a warm-up; fewer for slow ones)."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from chatterlake import catalog

HEADLINE = (
    "sov_brand", "sov_brand_weighted", "buzz_event_type", "top_issues", "dedup_exact_clusters", "dedup_near_pairs", "spam_mention_score",
    "quality_weight", "author_burstiness", "thread_summary", "thread_controversy", "topic_tokens", "text_stats", "quality_flags", "impact_score", "crisis_level", "insight_cards",
)


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    for name in HEADLINE:
        times = []
        for _ in range(4):
            began = time.perf_counter()
            catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
            if sum(times) > 8:
                break
        took[name] = round(statistics.median(times[1:] or times), 3)
        print(name, took[name], file=sys.stderr, flush=True)
    posts = spark.read.parquet(f"{folder}/documents.parquet").count()
    stages = sum(took[n] for n in ("dedup_exact_clusters", "spam_mention_score", "quality_weight", "quality_flags", "text_stats"))
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "posts": posts, "posts_per_second_text_stages": round(posts / stages, 1), "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
