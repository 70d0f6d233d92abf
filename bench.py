"""Headline timings: one JSON line on standard output.

The given tables are single files of one row group, which Spark reads as one task. They are first rewritten as
one file per core into a fresh folder, as a stored table would be; that time is reported apart. Figures are medians
of three runs, with the first ones beside; model fits run once.
"""

from __future__ import annotations

import contextlib
import json
import os
import sys
import tempfile
import time

from gablework.plans.queries import REGISTRY, validated
from gablework.session import local_session

TABLES = ["lineitem", "orders", "events", "documents", "pages", "part", "customer", "nation", "region"]
QUERIES = [
    "normalize_validate",
    "quality_summary",
    "top_provinces",
    "latest_features",
    "route_messages",
    "page_links",
    "counter_rate",
    "alert_error_rate",
    "alert_firing",
    "tfidf_terms",
    "ridge_fit",
    "gbt_fit",
    "batch_score_summary",
]
#: Fitted once per session and then kept: what counts is the first run.
FITS = ["ridge_fit", "gbt_fit"]


def write_nowhere(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    chosen = os.environ.get("BENCH_QUERIES", ",".join(QUERIES)).split(",")
    with contextlib.redirect_stdout(sys.stderr):
        spark = local_session(cores, partitions=cores, memory=os.environ.get("BENCH_MEMORY", "16g"))
        folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        started = time.time()
        for table in TABLES:
            rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
            rows.repartition(cores).write.parquet(f"{folder}/{table}.parquet")
        staged = time.time() - started
        rows = {t: spark.read.parquet(f"{folder}/{t}.parquet").count() for t in ("lineitem", "orders", "events")}
        seconds: dict[str, float] = {}
        first: dict[str, float] = {}
        for name in chosen:
            run = validated if name == "normalize_validate" else REGISTRY[name]
            times = []
            for _ in range(1 if name in FITS else repeats):
                started = time.time()
                write_nowhere(run(spark, folder))
                times.append(time.time() - started)
            seconds[name], first[name] = round(sorted(times)[len(times) // 2], 3), round(times[0], 3)
            print(name, seconds[name], file=sys.stderr, flush=True)
        version = spark.version
        spark.stop()
    result = {
        "metric": "total_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "first_runs": first,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "rows": rows,
        "staging_sec": round(staged, 3),
        "cores": cores,
        "repeats": repeats,
        "spark": version,
    }
    if "normalize_validate" in seconds:
        result["normalize_rows_per_sec"] = round(rows["lineitem"] / seconds["normalize_validate"])
    print(json.dumps(result))


if __name__ == "__main__":
    main()
