"""Out-of-sample metrics, deciles and comparisons of predictions.

All functions read a long table with ``actual`` and ``predicted`` and group it by any
columns. ``scope`` of a rank decides how ranks are computed: per day they use ordinary
windows (a day is bounded by the decision grid), over everything the distributed ranks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegrid.functions.ordering import average_ranks, running_totals


def _correlation(left: Column, right: Column) -> Column:
    """0 for fewer than two rows or a constant side (the built-in corr would divide by zero)."""
    spread = F.stddev_pop(left) * F.stddev_pop(right)
    return F.when(spread > 0, F.covar_pop(left, right) / spread).otherwise(0.0)


def _error_aggregates(with_ranks: bool) -> list[Column]:
    error = F.col("actual") - F.col("predicted")
    reference = F.col("actual") - F.col("training_mean")
    model, base = F.sum(error * error), F.sum(reference * reference)
    columns = [
        F.count("*").alias("rows"),
        F.when(base > 0, 1 - model / base).otherwise(0.0).alias("oos_r2"),
        F.avg(error * error).alias("mse"),
        F.avg(F.abs(error)).alias("mae"),
        _correlation(F.col("actual"), F.col("predicted")).alias("pearson_ic"),
    ]
    if with_ranks:
        columns.append(_correlation(F.col("_rank_a"), F.col("_rank_p")).alias("rank_ic"))
    return columns


def with_global_ranks(frame: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Average ranks of both columns over whole groups of any size.

    Each rank table has one row per distinct value; rows look their ranks up by equi-join,
    where adaptive execution splits a value that fills a large share of the rows.
    """
    actual = average_ranks(frame, groups, "actual", "_rank_a")
    predicted = average_ranks(frame, groups, "predicted", "_rank_p")
    return frame.join(actual, [*groups, "actual"]).join(predicted, [*groups, "predicted"])


def with_window_ranks(frame: DataFrame, groups: Sequence[str]) -> DataFrame:
    """The same ranks for groups that are bounded by the decision grid of a day."""
    ranks = {}
    for column, name in (("actual", "_rank_a"), ("predicted", "_rank_p")):
        order = W.partitionBy(*groups).orderBy(column)
        ties = F.count("*").over(W.partitionBy(*groups, column))
        ranks[name] = F.rank().over(order) + (ties - 1) / 2
    return frame.withColumns(ranks)


def regression_metrics(frame: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """R2 against the training mean, MSE, MAE, Pearson and rank correlation.

    Needs ``training_mean`` on every row.
    """
    ranked = with_global_ranks(frame, groups)
    return ranked.groupBy(*groups).agg(*_error_aggregates(True))


def daily_regression_metrics(frame: DataFrame, groups: Sequence[str]) -> DataFrame:
    ranked = with_window_ranks(frame, groups)
    return ranked.groupBy(*groups).agg(*_error_aggregates(True))


def rank_ic(frame: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    ranked = with_global_ranks(frame, groups)
    rank = _correlation(F.col("_rank_a"), F.col("_rank_p")).alias("rank_ic")
    return ranked.groupBy(*groups).agg(F.count("*").alias("rows"), rank)


def _score_table(frame: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Positives and negatives per distinct score, best score first."""
    return frame.groupBy(*groups, "predicted").agg(
        F.count_if(F.col("actual") == 1).alias("_pos"),
        F.count_if(F.col("actual") != 1).alias("_neg"),
    ).withColumn("_descending", -F.col("predicted"))


def _curve_metrics(scores: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Rank-sum AUC and step-wise average precision from counts above each score."""
    above_pos, pos, neg = F.col("above_pos"), F.col("_pos"), F.col("_neg")
    total_pos, total_neg = F.col("above_pos_total"), F.col("above_neg_total")
    pairs = F.sum(neg * (above_pos + pos / 2))
    precision = (above_pos + pos) / (above_pos + pos + F.col("above_neg") + neg)
    gain = F.sum(pos * precision)
    return scores.groupBy(*groups).agg(
        F.max(total_pos).alias("_p"), F.max(total_neg).alias("_n"),
        pairs.alias("_pairs"), gain.alias("_gain"),
    ).select(
        *groups,
        F.when((F.col("_p") > 0) & (F.col("_n") > 0), F.col("_pairs") / (F.col("_p") * F.col("_n")))
        .otherwise(0.0)
        .alias("roc_auc"),
        F.when(F.col("_p") > 0, F.col("_gain") / F.col("_p")).otherwise(0.0).alias("pr_auc"),
    )


def _probability_metrics(frame: DataFrame, groups: Sequence[str]) -> DataFrame:
    actual, predicted = F.col("actual").cast("double"), F.col("predicted")
    error = predicted - actual
    hit = (predicted >= 0.5) == (actual == 1)
    return frame.groupBy(*groups).agg(
        F.count("*").alias("rows"),
        F.avg(error * error).alias("brier"),
        F.avg(hit.cast("double")).alias("accuracy"),
        F.avg(actual).alias("class_balance"),
    )


def classification_metrics(frame: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """AUC, average precision, Brier score, accuracy at 0.5 and class balance.

    Scores are counted per distinct value and accumulated over ranges, so neither a huge
    group nor a frequent score ends up in one task.
    """
    totals = running_totals(
        _score_table(frame, groups),
        groups,
        ["_descending", *groups],
        {"above_pos": "_pos", "above_neg": "_neg"},
    )
    return _join_groups(_probability_metrics(frame, groups), _curve_metrics(totals, groups), groups)


def _join_groups(left: DataFrame, right: DataFrame, groups: Sequence[str]) -> DataFrame:
    if groups:
        return left.join(right, list(groups))
    return left.withColumn("_one", F.lit(1)).join(right.withColumn("_one", F.lit(1)), "_one").drop("_one")


def daily_classification_metrics(frame: DataFrame, groups: Sequence[str]) -> DataFrame:
    """The same metrics for groups bounded by a day."""
    above = W.partitionBy(*groups).orderBy("_descending").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*groups)
    columns = {}
    for name, source in (("above_pos", "_pos"), ("above_neg", "_neg")):
        columns[name] = F.coalesce(F.sum(source).over(above), F.lit(0))
        columns[f"{name}_total"] = F.sum(source).over(whole)
    scores = _score_table(frame, groups).withColumns(columns)
    return _join_groups(_probability_metrics(frame, groups), _curve_metrics(scores, groups), groups)


def _positions(frame: DataFrame, groups: Sequence[str], ties: Sequence[str]) -> DataFrame:
    """Position of each row in (prediction, ties) order; ``ties`` makes the order unique."""
    numbered = frame.withColumn("_one", F.lit(1))
    return running_totals(numbered, groups, ["predicted", *ties, *groups], {"position": "_one"})


def _decile_table(frame: DataFrame, groups: Sequence[str]) -> DataFrame:
    return frame.groupBy(*groups, "decile").agg(
        F.count("*").alias("rows"),
        F.avg("predicted").alias("mean_prediction"),
        F.avg("actual").alias("mean_actual"),
    )


def deciles_floor(frame: DataFrame, groups: Sequence[str], ties: Sequence[str]) -> DataFrame:
    """Decile = floor(position * 10 / rows) + 1."""
    placed = _positions(frame, groups, ties)
    decile = F.floor(F.col("position") * 10 / F.col("position_total")) + 1
    return _decile_table(placed.withColumn("decile", F.least(decile, F.lit(10))), groups)


def deciles_equal(frame: DataFrame, groups: Sequence[str], ties: Sequence[str]) -> DataFrame:
    """Ten nearly equal groups, the first ``rows % 10`` of them one row larger."""
    placed = _positions(frame, groups, ties)
    small = F.floor(F.col("position_total") / 10)
    extra = F.col("position_total") % 10
    cut = extra * (small + 1)
    position = F.col("position")
    decile = F.when(position < cut, F.floor(position / (small + 1))).otherwise(
        extra + F.floor((position - cut) / F.greatest(small, F.lit(1)))
    )
    return _decile_table(placed.withColumn("decile", decile.cast("long") + 1), groups)


def paired_daily_loss(
    left: DataFrame, right: DataFrame, keys: Sequence[str], metric: str = "mse"
) -> DataFrame:
    """Improvement of right over left on the keys both have."""
    a = left.select(*keys, F.col(metric).alias(f"left_{metric}"))
    b = right.select(*keys, F.col(metric).alias(f"right_{metric}"))
    gain = F.col(f"left_{metric}") - F.col(f"right_{metric}")
    return a.join(b, list(keys)).withColumn("improvement", gain)


def model_ranking(fold_metrics: DataFrame) -> DataFrame:
    """Mean fold R2 of each (model, scope) and its place."""
    means = fold_metrics.groupBy("model", "scope").agg(F.avg("oos_r2").alias("mean_fold_oos_r2"))
    best = W.orderBy(F.col("mean_fold_oos_r2").desc(), "model", "scope")  # one row per model
    return means.withColumn("place", F.row_number().over(best))


def best_candidate(candidates: DataFrame, order: Sequence[str]) -> DataFrame:
    """The first candidate in the given order (smallest loss, then tie-breaks)."""
    return candidates.orderBy(*order).limit(1)


def circular_shift(
    frame: DataFrame, groups: Sequence[str], columns: Sequence[str], shift: int, order: str
) -> DataFrame:
    """Row i of a day gets the columns of row (i - shift) mod n of the same day.

    Days are bounded by the decision grid; the shifted copy is found by equi-join.
    """
    day = W.partitionBy(*groups).orderBy(order)
    numbered = frame.withColumns(
        {"_row": F.row_number().over(day) - 1, "_rows": F.count("*").over(W.partitionBy(*groups))}
    )
    donors = numbered.select(
        *groups,
        F.pmod(F.col("_row") + shift, F.col("_rows")).alias("_row"),
        *(F.col(c).alias(f"_shifted_{c}") for c in columns),
    )
    kept = [c for c in frame.columns if c not in columns]
    return numbered.join(donors, [*groups, "_row"]).select(
        *kept, *(F.col(f"_shifted_{c}").alias(c) for c in columns)
    )


def model_selection(metrics: DataFrame, intervals: DataFrame, minimum_gain: float) -> DataFrame:
    """Prefer the candidate when its R2 gain and its bootstrap lower bound are large enough.

    ``metrics`` has one row with incumbent_r2 and candidate_r2, ``intervals`` one with lower.
    """
    one = F.lit(1).alias("_one")
    joined = metrics.select("*", one).join(intervals.select("lower", one), "_one")
    wins = (F.col("candidate_r2") >= F.col("incumbent_r2") + minimum_gain) & (F.col("lower") > 0)
    return joined.select(
        "incumbent_r2",
        "candidate_r2",
        "lower",
        F.when(wins, "candidate").otherwise("incumbent").alias("selected"),
    )
