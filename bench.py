"""Time the headline queries: one warm run, then the median of REPEATS runs into a noop sink.

Prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the tables and the cores.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from planlab.plans.registry import all_queries  # noqa: E402
from planlab.session import local_session  # noqa: E402
from planlab.sources.sinks import discard  # noqa: E402

HEADLINE = (
    "t1 t3 t11 t13 t17 t21 join_keep_right join_chain semi_residual anti_residual keep_first "
    "predicate_catalogue key_cardinality quantile_literals token_share group_describe category_blocks "
    "transitions walks propagate sample_uniform weighted_percentile trim_outliers templated_jobs"
).split()
REPEATS = int(os.environ.get("BENCH_REPEATS", "3"))


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, "planlab-bench")
    every, timings = all_queries(), {}
    names = sys.argv[1:] or HEADLINE
    for name in names:
        run = every[name][0]
        seconds = []
        for _ in range(REPEATS + 1):
            started = time.perf_counter()
            discard(run(spark, directory))
            seconds.append(time.perf_counter() - started)
        timings[name] = round(statistics.median(seconds[1:]), 4)
    scale = re.search(r"sf([0-9.]+)", directory)
    print(
        json.dumps(
            {
                "metric": "sum of median query seconds",
                "value": round(sum(timings.values()), 4),
                "unit": "sec",
                "queries": timings,
                "sf": float(scale.group(1)) if scale else None,
                "cores": cores,
                "heap": spark.sparkContext.getConf().get("spark.driver.memory"),
                "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
            }
        )
    )


if __name__ == "__main__":
    main()
