"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

``queries`` and ``value`` are first runs, planning and compilation included; ``again`` are second runs. Nothing is cached between them.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from wayline.plans import registry

HEADLINE = [
    "trip_summary", "motion_segments", "quality_summary", "event_top10", "rollup_60", "rollup_600", "hybrid_range", "display_series", "vibration_trend",
    "frame_decode", "import_violations", "fulfilment", "genealogy",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    spark.range(1000).selectExpr("sum(id)").collect()
    took, again = {}, {}
    for times in (took, again):
        for name in HEADLINE:
            spark.catalog.clearCache()
            began = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "again": again, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
