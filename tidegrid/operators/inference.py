"""Day-block bootstrap and regression with autocorrelation-robust errors."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegrid.functions.arrays import array_sums
from tidegrid.functions.ordering import exact_medians
from tidegrid.session import checkpointed


def day_bootstrap(improvements: DataFrame, day: str, replicates: int, seed: int) -> DataFrame:
    """Percentile interval of the mean of per-day improvements, days drawn with replacement.

    Rows of one day (of several symbols, say) move together, so a day counts as one block with their mean.
    Draw i of replicate r is a hash of (seed, r, i), so every run and every engine draws the
    same days. The days' means are one array of one row (eight bytes a day, some 30 kB a decade), which is sent
    to the replicates; each looks its draws up there, so no draw is a row and none is shuffled.
    Fewer than two days raise an error.
    """
    blocks = improvements.groupBy(day).agg(F.avg("improvement").alias("improvement"))
    too_few = F.raise_error(F.lit("a bootstrap needs two days or more")).cast("long")
    in_order = F.sort_array(F.collect_list(F.struct(day, "improvement")))
    days = checkpointed(
        blocks.agg(
            F.avg("improvement").alias("estimate"),
            F.when(F.count("*") >= 2, F.count("*")).otherwise(too_few).alias("days"),
            in_order["improvement"].alias("_means"),
        ).withColumn("_one", F.lit(1))
    )

    def drawn(draw: Column) -> Column:
        hashed = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("replicate"), draw))
        number = F.conv(F.substring(hashed, 1, 8), 16, 10).cast("long")
        return F.get("_means", F.pmod(number, F.col("days")).cast("int"))

    total = F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("days") - 1), F.lit(0.0), lambda s, draw: s + drawn(draw))
    spread = improvements.sparkSession.range(replicates).select(F.col("id").alias("replicate"), F.lit(1).alias("_one"))
    means = spread.join(F.broadcast(days), "_one").select((total / F.col("days")).alias("mean"))
    interval = means.agg(
        F.percentile("mean", 0.025).alias("lower"),
        F.percentile("mean", 0.975).alias("upper"),
        F.avg((F.col("mean") > 0).cast("double")).alias("probability_positive"),
    ).withColumn("_one", F.lit(1))
    return days.drop("_means").join(interval, "_one").drop("_one")


def indexed_rows(frame: DataFrame, group: str, order: str) -> DataFrame:
    """Consecutive ``_index`` per group along time, from day-sized windows and day offsets."""
    day = W.partitionBy(group, "date").orderBy(order)
    numbered = frame.withColumn("_in_day", F.row_number().over(day))
    sizes = frame.groupBy(group, "date").agg(F.count("*").alias("_size"))
    before = W.partitionBy(group).orderBy("date").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(group, "date", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    return numbered.join(offsets, [group, "date"]).withColumn(
        "_index", F.col("_start") + F.col("_in_day") - 1
    ).drop("_in_day", "_start")


def _normal_two_sided(t: float) -> float:
    if math.isnan(t):
        return math.nan
    return math.erfc(abs(t) / math.sqrt(2.0)) if math.isfinite(t) else 0.0


#: A feature whose variance is below this share of its mean square has no variation but rounding.
CONSTANT = 1e-12


def solve_standardised(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(means, deviations, coefficients, inverse, rows) from the cross products of [1, features, target].

    Features are standardised inside the products. A constant feature becomes a column of zeros, and
    the pseudo-inverse gives it a coefficient of zero, as it shares out equal columns.
    """
    width = len(gram) - 1
    count = gram[0, 0]
    mean = gram[0, 1:width] / count
    square = np.diag(gram)[1:width] / count
    variance = square - mean**2
    varies = variance > CONSTANT * square
    spread = np.where(varies, np.sqrt(np.where(varies, variance, 1.0)), 1.0)
    change = np.eye(width)
    change[0, 1:] = np.where(varies, -mean / spread, 0.0)
    change[1:, 1:] = np.diag(np.where(varies, 1 / spread, 0.0))
    inverse = np.linalg.pinv(change.T @ gram[:width, :width] @ change, hermitian=True)
    return mean, spread, inverse @ (change.T @ gram[:width, width]), inverse, int(round(count))


def hac_regression(
    frame: DataFrame, group: str, features: Sequence[str], target: str, max_lags: int,
    block_rows: int = 50_000,
) -> DataFrame:
    """OLS on median-imputed, standardised features with Bartlett-weighted errors, per group.

    Three distributed steps: exact medians; one pass for the cross products; and, with the
    coefficients known, lagged products over blocks of consecutive rows. A block also receives
    the last ``max_lags`` rows of the block before it, so no product across a block edge is
    lost and no task sees more than a block. Sums, fits and errors stay tables; nothing is collected.
    A constant feature has the coefficient and error zero and no t value; for a feature without any
    value both are NULL.
    """
    names = list(features)
    width = len(names) + 1
    rows = frame.where(F.col(target).isNotNull())
    kind = dict(frame.dtypes)[group]
    medians = exact_medians(rows, [group], names).groupBy(group).agg(
        *(F.max(F.when(F.col("name") == n, F.col("median"))).alias(f"_m_{n}") for n in names)
    )
    filled = rows.join(medians, group).select(
        group, "date", "decision_time_ns", F.col(target).cast("double").alias("_y"),
        *(F.coalesce(F.col(n).cast("double"), F.col(f"_m_{n}"), F.lit(0.0)).alias(n) for n in names),
    )

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, part in batch.groupby(group):
                x = np.column_stack([np.ones(len(part)), part[names].to_numpy(float), part["_y"]])
                yield pd.DataFrame({group: [key], "m": [(x.T @ x).ravel().tolist()]})

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, flat in zip(batch[group], batch["m"]):
                mean, spread, beta, inverse, count = solve_standardised(np.asarray(flat).reshape(width + 1, width + 1))
                out.append((key, mean.tolist(), spread.tolist(), beta.tolist(), inverse.ravel().tolist(), count))
            yield pd.DataFrame(out, columns=[group, "mean", "spread", "beta", "inverse", "count"])

    sums = array_sums(filled.mapInPandas(products, f"{group} {kind}, m array<double>"), [group])
    numbers = ", ".join(f"{n} array<double>" for n in ("mean", "spread", "beta", "inverse"))
    # One row per group, read by the lagged products and by the errors.
    fits = checkpointed(sums.mapInPandas(fit, f"{group} {kind}, {numbers}, count long"))

    block = F.floor(F.col("_index") / block_rows)
    late = F.pmod("_index", F.lit(block_rows)) >= block_rows - max_lags
    indexed = indexed_rows(filled, group, "decision_time_ns")
    blocked = indexed.withColumn(
        "_block", F.explode(F.when(late, F.array(block, block + 1)).otherwise(F.array(block)))
    )
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("count") / block_rows)))
    by_block = fits.select(group, "mean", "spread", "beta", blocks.alias("_block"))

    def lagged(key: tuple[Any, ...], part: pd.DataFrame, fitted: pd.DataFrame) -> pd.DataFrame:
        if part.empty or fitted.empty:
            return pd.DataFrame({group: [], "lag": [], "m": []})
        mean, spread, beta = (np.asarray(fitted[n].iloc[0]) for n in ("mean", "spread", "beta"))
        part = part.sort_values("_index")
        x = np.column_stack([np.ones(len(part)), (part[names].to_numpy(float) - mean) / spread])
        scores = x * (part["_y"].to_numpy() - x @ beta)[:, None]
        own = (part["_index"].to_numpy() // block_rows) == key[1]
        out = []
        for lag in range(max_lags + 1):
            here = np.flatnonzero(own)
            here = here[here - lag >= 0]
            out.append((scores[here].T @ scores[here - lag]).ravel().tolist())
        return pd.DataFrame({group: key[0], "lag": range(len(out)), "m": out})

    gammas = array_sums(
        blocked.groupBy(group, "_block").cogroup(by_block.groupBy(group, "_block")).applyInPandas(
            lagged, f"{group} {kind}, lag int, m array<double>"
        ),
        [group, "lag"],
    )
    lags = gammas.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("lag", "m")))["m"].alias("lags"))

    def errors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                beta, inverse = np.asarray(row.beta), np.asarray(row.inverse).reshape(width, width)
                meat = np.zeros((width, width))
                for lag, flat in enumerate(row.lags):
                    gamma = np.asarray(flat).reshape(width, width)
                    meat += gamma if lag == 0 else (1.0 - lag / (max_lags + 1.0)) * (gamma + gamma.T)
                error = np.sqrt(np.maximum(np.diag(inverse @ meat @ inverse), 0.0))
                key = getattr(row, group)
                for i, term in enumerate(["intercept", *names]):
                    t = beta[i] / error[i] if error[i] > 0 else math.nan
                    out.append((key, term, beta[i], error[i], t, _normal_two_sided(t), row.count_, max_lags))
            yield pd.DataFrame(out, columns=[n.split()[0] for n in schema.split(", ")])

    schema = (
        f"{group} {kind}, term string, coefficient double, standard_error double, t_value double, "
        "p_value double, observations long, hac_max_lags int"
    )
    solved = fits.withColumnRenamed("count", "count_").join(lags, group).mapInPandas(errors, schema)
    empty = medians.select(
        group, F.array_compact(F.array(*(F.when(F.col(f"_m_{n}").isNull(), n) for n in names))).alias("_empty")
    )
    known = ~F.array_contains("_empty", F.col("term"))
    # pandas has NaN for a missing t value
    value = {n: F.when(known & ~F.isnan(n), F.col(n)) for n in ("coefficient", "standard_error", "t_value", "p_value")}
    return solved.join(empty, group).withColumns(value).drop("_empty")
