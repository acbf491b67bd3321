"""Headline queries on local[$BENCH_CPUS]; prints one JSON line.

Every query runs once to warm up and is then timed (median of $BENCH_REPEATS runs). Queries of
the later stages read the stored feature table, whose making is timed as ``feature_frame`` and
``store_scores``; fills and ledgers are always computed anew. ``events_per_second`` covers scan,
shuffle and gap filling of bars, with the cores and settings shown; it is not comparable one
to one with an in-memory kernel.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from tidegrid import catalog
from tidegrid.operators.bars import base_bars
from tidegrid.session import build_session

REPEATS = int(os.environ.get("BENCH_REPEATS", "2"))
HEADLINE = (
    "base_bars",
    "two_market_bars",
    "trade_flow_features",
    "feature_frame",
    "validate_trades",
    "asof_forward_fill",
    "regression_metrics",
    "classification_metrics",
    "deciles_ntile",
    "day_bootstrap",
    "non_overlapping_trades",
    "sensitivity_grid",
    "train_only_scaling",
    "linear_walk_forward",
    "logistic_walk_forward",
    "stream_bars",
)


def dense_bars(spark, sf_dir):
    """Hourly bars of the order lines: the larger throughput case."""
    return base_bars(catalog.dense_trades(spark, sf_dir), 3_600_000 * 1_000_000)


def store_scores(spark, sf_dir):
    """Features and scores from the raw table into the tables the later stages read."""
    catalog.forget("features", "scored")
    return catalog._scored(spark, sf_dir)


def timed(spark, query, sf_dir: str) -> float:
    catalog.forget("backtest")
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    partitions = int(cpus) if cpus.isdigit() else 8
    spark = build_session(f"local[{cpus}]", partitions, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    rows = {
        "base_bars": spark.read.parquet(f"{sf_dir}/events.parquet").count(),
        "dense_bars": spark.read.parquet(f"{sf_dir}/lineitem.parquet").count(),
    }
    rows["two_market_bars"] = rows["stream_bars"] = rows["base_bars"]
    queries = {"dense_bars": dense_bars, "store_scores": store_scores}
    queries.update({name: catalog.QUERIES[name] for name in HEADLINE})
    timings = {}
    for name, query in queries.items():
        timed(spark, query, sf_dir)
        runs = [timed(spark, query, sf_dir) for _ in range(REPEATS)]
        timings[name] = round(statistics.median(runs), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "events_per_second": {name: round(rows[name] / timings[name]) for name in rows},
                "cores": cpus,
                "shuffle_partitions": partitions,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
