"""Fitted models to signals: the threshold of a model comes from predictions it has not been fitted on.

A model is a row of a stored table: medians, intercept and weights of the final fit on all development rows, the signal
threshold from an earlier fit's predictions after a boundary within development, and the median volatility. Fills and
ledgers then read predictions and that table alone.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.ordering import exact_median
from tidegrid.operators import linear, splits, trees
from tidegrid.plans import research
from tidegrid.session import stored

SIGNAL_KEYS = ("symbol", "date", "decision_time_ns")


def positive_threshold(value: Column) -> Column:
    """The threshold, or an error where it is no positive number: then every row would be a signal, or none."""
    sound = value.isNotNull() & ~F.isnan(value) & (value > 0) & (value < float("inf"))
    problem = F.raise_error(F.concat(F.lit("no positive signal threshold for "), F.col("symbol")))
    return F.when(sound, value).otherwise(problem.cast("double"))


def calibration(development: DataFrame, target: str, boundary_date: str, purge_seconds: int) -> tuple[DataFrame, DataFrame]:
    """Training and validation rows with a known target; an empty side raises."""
    known = development.where(F.col(target).isNotNull())
    sides = splits.boundary_split(known, boundary_date, purge_seconds)
    for name, side in zip(("training", "validation"), sides):
        if side.limit(1).count() == 0:
            raise ValueError(f"the {name} side of the calibration split is empty")
    return sides


def thresholds(validated: DataFrame, development: DataFrame, sigma: float, volatility: str) -> DataFrame:
    """(symbol, signal_threshold, median_volatility): sigma deviations of the validation predictions, and the
    exact median volatility of all development rows."""
    spread = validated.groupBy("symbol").agg((sigma * F.stddev_pop("predicted")).alias("signal_threshold"))
    usual = exact_median(development, ["symbol"], volatility, "median_volatility")
    return spread.join(usual, "symbol").withColumn("signal_threshold", positive_threshold(F.col("signal_threshold")))


def _ridge(train: DataFrame, features: Sequence[str], target: str, alpha: float) -> DataFrame:
    sums = linear.products(train, ("symbol",), features, [target]).select("symbol", "m")
    medians = linear.train_medians(train, ("symbol",), features)
    fits = linear.fitted(sums, medians, ("symbol",), features, {"expanded": features}, {"ridge": alpha})
    return fits.where("train_rows > 0")


def _scored(rows: DataFrame, fits: DataFrame, features: Sequence[str], *columns: str) -> DataFrame:
    kept = [*SIGNAL_KEYS, *columns]
    return rows.join(fits, "symbol").select(*kept, F.expr(linear.linear_score(features)).alias("predicted"))


def ridge_models(
    development: DataFrame, features: Sequence[str], target: str, alpha: float,
    boundary_date: str, purge_seconds: int, sigma: float, volatility: str,
) -> DataFrame:
    """The model table of a ridge per symbol."""
    train, validation = calibration(development, target, boundary_date, purge_seconds)
    validated = _scored(validation, stored(_ridge(train, features, target, alpha), "calibration-fits"), features)
    final = _ridge(development.where(F.col(target).isNotNull()), features, target, alpha)
    return stored(final.join(thresholds(validated, development, sigma, volatility), "symbol"), "models")


def ridge_predictions(models: DataFrame, rows: DataFrame, features: Sequence[str], target: str, volatility: str) -> DataFrame:
    """(symbol, date, decision_time_ns, prediction, volatility) of the rows with a known target."""
    known = rows.where(F.col(target).isNotNull()).withColumn("volatility", F.col(volatility))
    return _scored(known, models, features, "volatility").withColumnRenamed("predicted", "prediction")


def tree_thresholds(
    development: DataFrame, features: Sequence[str], target: str, params: Mapping[str, trees.TreeParams],
    boundary_date: str, purge_seconds: int, stride_ns: int, sigma: float, volatility: str,
) -> DataFrame:
    """Thresholds of the chosen trees, from a fit on the rows before the boundary; ``stride_ns`` as in ``tree_holdout``."""
    train, validation = calibration(development, target, boundary_date, purge_seconds)
    validated = research.tree_holdout(train, validation, features, target, params, stride_ns)
    return stored(thresholds(validated, development, sigma, volatility), "tree-thresholds")
