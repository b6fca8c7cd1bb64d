"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` (tables), ``BENCH_CPUS`` (cores) and ``BENCH_RUNS`` (warm runs, median taken) can be
set in the environment. Every run builds the query anew and writes all of its rows to Spark's no-op sink.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

from furrow.operators.rasters import index_scenes
from furrow.operators.scenes import index_features
from parity.queries import QUERIES
from parity.surrogates import tile_scene_table

HEADLINE = [
    "weather_monthly", "weather_monthly_untied", "dry_streak", "weather_anomaly", "weather_lags", "day_measures",
    "season_weather", "ndvi_statistics", "ndvi_patches", "ndvi_features", "ag_statistics",
    "ag_features", "patch_boundaries", "season_ndvi", "label_choice", "label_anchors",
    "joined_modalities", "month_wide", "anchor_records", "fusion_flat", "input_checks",
]


def tile_features(spark: SparkSession, sf_dir: str):
    """All features of vegetation tiles of 128x128 pixels, 256 embeddings each."""
    return index_features(index_scenes(tile_scene_table(spark, sf_dir)))


MORE = {"tile_features": tile_features}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("furrow-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name, query in [*((n, QUERIES[n]) for n in HEADLINE), *MORE.items()]:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            query(spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken[1:]), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total_warm_query_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(scale.group(1)) if scale else None,
                "cores": int(cpus),
                "runs": runs,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
