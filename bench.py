"""Headline queries, timed end to end. Prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from stripgrid.catalog.queries import QUERIES
from stripgrid.session import session

HEADLINE = [
    "gram",
    "gram_wide",
    "lsq_normal",
    "ridge_normal",
    "lsq_tsqr",
    "ridge_tsqr",
    "lsq_many_targets_tsqr",
    "tsqr_r",
    "tsqr_q",
    "tsqr_q_direct",
    "cond_numbers",
    "block_qr_r",
    "sgd_ridge",
    "sgd_mini_batch",
    "bcd_normal",
    "bcd_tsqr",
    "bcd_streaming",
    "residual_norms",
    "norm_fro",
    "col_sum_events",
    "row_sum",
    "elem_pow",
    "strip_map",
    "mat_times_local_wide",
    "mat_add",
    "slice_both",
    "block_grid",
    "block_slice_both",
    "block_row_sum",
    "block_col_sum",
    "accuracy_sweep",
]
REPEATS = 2


def run(query, spark, folder: str) -> float:
    started = time.perf_counter()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    run(QUERIES["gram_wide"], spark, folder)  # starts the Python workers
    times = {name: round(min(run(QUERIES[name], spark, folder) for _ in range(REPEATS)), 3) for name in HEADLINE}
    print(
        json.dumps(
            {
                "metric": "total of headline queries, best of two runs each",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")),
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
