"""Benchmark the headline analyses.

Runs each headline query over ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1)
on ``local[$BENCH_CPUS]`` and prints one JSON line with the median of
``$BENCH_REPS`` (default 3) runs per query. Each result is fully computed and
discarded through the ``noop`` sink (no driver collect).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from driftline.plans.catalog import QUERIES  # noqa: E402
from driftline.session import build_session  # noqa: E402

HEADLINE = (
    "q_fish_full", "q_fish_early", "q_fish_recent", "q_sd_weighted",
    "q_zoo_full", "q_zoo_early", "q_zoo_recent", "q_run_mean_final",
    "q_fish_draft", "q_zoo_draft", "q_sd_annual", "q_plot_layers", "q_unpivot",
    "q_duplicates",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1].split(",") if len(sys.argv) > 1 else list(HEADLINE)
    conf = {"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g"),
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32m"}
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=cpus, app="bench",
                          conf=conf)
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="bench-ckpt-"))

    # warm the JVM (class loading, JIT, codegen caches) on the smallest tables
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.01")
    if os.path.isdir(warm_dir):
        for name in names:
            QUERIES[name](spark, warm_dir).write.format("noop").mode("overwrite").save()

    # median of several runs: single runs on a shared VM vary by up to ~30 %
    reps = int(os.environ.get("BENCH_REPS", "3"))
    runs: dict[str, list[float]] = {name: [] for name in names}
    for _ in range(reps):
        for name in names:
            spark.catalog.clearCache()  # every query starts from the parquet files
            t0 = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs[name].append(time.perf_counter() - t0)
    times = {name: round(statistics.median(t), 3) for name, t in runs.items()}
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": cpus,
                      "reps": reps, "stat": "median"}))
    spark.stop()


if __name__ == "__main__":
    main()
