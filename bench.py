"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line of seconds, each the median of three warm runs."""

from __future__ import annotations

import json
import os
import shutil
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "a02_contingency", "a03_probabilistic", "a08_atlas", "a11_psi", "a17_granule_day", "a21_quantile_table", "a24_day_bootstrap", "a31_district_product", "a05_fss_5", "f01_feature_table",
    "j01_window_join", "j05_conservative_regrid", "j09_system_influence", "j16_analogues", "m01_ratio_model", "m02_quantile_mapping", "w03_gaussian", "w08_run_filter",
]


def main() -> None:
    from pyspark.sql import SparkSession

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    shared = tempfile.mkdtemp(prefix="raincask-bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", shared).config("spark.sql.warehouse.dir", f"{shared}/warehouse").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from raincask.plans import registry

    seconds = {}
    for name in HEADLINE:
        took = []
        for _ in range(4):
            began = time.time()
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.time() - began)
        seconds[name] = round(statistics.median(took[1:]), 3)
    spark.stop()
    shutil.rmtree(shared, ignore_errors=True)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
