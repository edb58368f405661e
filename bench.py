"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

QUERIES = [
    "weekly_effect",
    "L17_state_week_panel",
    "L18_state_day_panel",
    "W5_feature_generator",
    "W10_group_zscore",
    "W16_step_panel",
    "C2_full_outer",
    "D12_group_stats_on_rows",
    "J1_ols_hc1",
    "J6_entity_effects",
    "J7_quadratic_trends",
    "J11_tsls_just_identified",
    "J22_cross_validated_lasso",
    "J23_model_grid",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from panelspark.session import name_shared_folder
    from querybook import load_all

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("panelspark-bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    name_shared_folder(spark)
    registry = load_all()
    registry["A8_clean_table_read"].run(spark, sf).collect()  # start the session's machinery
    times = {}
    for name in QUERIES:
        start = time.time()
        registry[name].run(spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall-clock",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
