"""Time headline queries: one warm-up, then one timed run each; prints one JSON line.

BENCH_SF_DIR chooses the tables, BENCH_CPUS the local threads, BENCH_QUERIES a comma list of names.
"""
from __future__ import annotations

import json
import os
import sys
import time

import catalogue
from quartier.session import build_session

HEADLINE = [
    "x7_population_share",
    "a1_zonal_sum_settlements",
    "j1_buildings_in_settlements",
    "s1_buildings_in_box",
    "r4_sliding_windows",
    "w3_w4_fold_split",
    "r1_rasterize",
    "x2_prepared_tiles",
    "m14_normalised_bands",
    "a12_smoothed_scores",
    "a16_x6_city_metrics",
    "w7_sparse_opening",
    "x1_composite",
    "x9_a22_compared_morphometrics",
    "x8_morphometrics",
    "c1_region_labels",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    catalogue.load()

    def run(name: str) -> float:
        start = time.perf_counter()
        catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in names:
        run(name)
        seconds[name] = round(run(name), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf,
    }))


if __name__ == "__main__":
    main()
