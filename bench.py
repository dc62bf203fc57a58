"""Times the headline queries on the driver's tables and prints one JSON line.

Each query runs twice; its time is that of the second run, once its code is compiled (``first`` has the other). Queries
on logs run on logs that are written beforehand, which ``fixture`` times.
"""

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession

from meterglass.plans.queries import QUERIES, count_lines, extracted, logs

HEADLINES = ["rolling_windows", "window_by_model", "model_rollup", "by_account", "activity_series", "range_by_day", "merge_usage", "rollout_usage", "asof_attribution", "priced_usage", "scan_lines", "usage_extract", "facts_store", "limits_normalize_a", "limits_normalize_b", "daily_sales", "usage_report", "windows_at_moments"]
ON_LOGS = {"scan_lines": count_lines, "usage_extract": extracted}


def seconds(make) -> float:
    start = time.perf_counter()
    found = make()
    if isinstance(found, DataFrame):
        found.write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    folder: list[str] = []
    fixture = seconds(lambda: folder.append(logs(spark, sf_dir)))
    times, first = {}, {}
    for name in HEADLINES:
        make = (lambda f=ON_LOGS[name]: f(spark, folder[0])) if name in ON_LOGS else (lambda f=QUERIES[name]: f(spark, sf_dir))
        first[name], times[name] = seconds(make), seconds(make)
    out = {"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")), "first": first, "fixture": {"logs": fixture}}
    print(json.dumps(out))


if __name__ == "__main__":
    main()
