"""Feature table to predictions and metrics: walk-forward runs, confirmation and holdout."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.operators import evaluation, linear, splits, trees
from tidegrid.params import DAY_NS, NS_PER_SECOND, FeatureSets
from tidegrid.session import stored

PREDICTION_KEYS = ("symbol", "fold", "model", "scope")


def fold_training_mean(split: DataFrame, target: str, groups: Sequence[str] = ("symbol", "fold")) -> DataFrame:
    """Mean target of each fold's training rows."""
    return split.where("role = 'train'").groupBy(*groups).agg(F.avg(target).alias("training_mean"))


def reference_predictions(split: DataFrame, target: str) -> DataFrame:
    """Training-mean and zero predictions of every evaluation row, as a long table."""
    rows = split.where((F.col("role") == "evaluate") & F.col(target).isNotNull())
    rows = rows.select("symbol", "fold", "date", "decision_time_ns", F.col(target).alias("actual"))
    joined = rows.join(fold_training_mean(split, target), ["symbol", "fold"])
    pairs = F.array(
        F.struct(F.lit("training_mean").alias("model"), F.col("training_mean").alias("predicted")),
        F.struct(F.lit("zero").alias("model"), F.lit(0.0).alias("predicted")),
    )
    return joined.select("*", F.inline(pairs)).withColumn("scope", F.lit("reference"))


def _fold_sums(features: DataFrame, folds: DataFrame, names: Sequence[str], target: str, purge_seconds: int) -> DataFrame:
    """(symbol, fold, m): cross products of every fold's training rows, from one pass over the table."""
    if not 0 <= purge_seconds * NS_PER_SECOND < DAY_NS:
        raise ValueError("the purge must be shorter than a day")
    late = F.pmod("decision_time_ns", F.lit(DAY_NS)) >= DAY_NS - purge_seconds * NS_PER_SECOND
    daily = linear.products(features.withColumn("late", late), ("symbol", "date", "late"), names, [target])
    return linear.fold_products(stored(daily.drop("target"), "day-sums"), folds)


def _fold_medians(features: DataFrame, folds: DataFrame, names: Sequence[str], target: str, purge_seconds: int) -> DataFrame:
    split = splits.walk_forward_split(features, folds, purge_seconds)
    train = split.where((F.col("role") == "train") & F.col(target).isNotNull())
    return linear.train_medians(train, ("symbol", "fold"), names)


def linear_fits(
    features: DataFrame, folds: DataFrame, sets: FeatureSets, target: str, ridge_alpha: float, purge_seconds: int
) -> DataFrame:
    """Linear and ridge fits of both scopes for every (symbol, fold), NULL for one without training rows.

    One pass collects cross products per (symbol, date); a fold's training sums are a difference of running sums
    over days, so overlapping training sets cost nothing. Sums and fits stay tables.
    """
    names = sets.expanded
    return stored(
        linear.fitted(
            _fold_sums(features, folds, names, target, purge_seconds),
            _fold_medians(features, folds, names, target, purge_seconds),
            ("symbol", "fold"), names, {"baseline": sets.baseline, "expanded": names}, {"linear": 0.0, "ridge": ridge_alpha},
        ),
        "linear-fits",
    )


def linear_predictions(
    features: DataFrame, folds: DataFrame, sets: FeatureSets, target: str,
    ridge_alpha: float, purge_seconds: int,
) -> DataFrame:
    """Out-of-sample predictions of linear and ridge models, both scopes, every fold that a symbol has training rows in.

    A fold with an empty or overlapping side raises.
    """
    splits.require_split(features, folds, purge_seconds)
    table = linear_fits(features, folds, sets, target, ridge_alpha, purge_seconds).where("train_rows > 0")
    split = splits.walk_forward_split(features, folds, purge_seconds)
    scored = split.where((F.col("role") == "evaluate") & F.col(target).isNotNull()).join(
        table, ["symbol", "fold"]
    )
    return scored.select(
        *PREDICTION_KEYS,
        "date",
        "decision_time_ns",
        F.col(target).alias("actual"),
        F.expr(linear.linear_score(sets.expanded)).alias("predicted"),
        "training_mean",
    )


def fixed_split_predictions(
    train: DataFrame, evaluation_rows: DataFrame, sets: FeatureSets, targets: Sequence[str],
    ridge_alpha: float,
) -> DataFrame:
    """Ridge fitted once per (symbol, target, scope) and scored on other rows.

    Serves the horizon comparison and the replication on other symbols in one pass.
    """
    names, scopes = sets.expanded, {"baseline": sets.baseline, "expanded": sets.expanded}
    sums = stored(linear.products(train, ("symbol",), names, targets), "sums")
    parts = []
    for target in targets:
        medians = linear.train_medians(train.where(F.col(target).isNotNull()), ("symbol",), names)
        own = sums.where(F.col("target") == target).select("symbol", "m")
        table = stored(linear.fitted(own, medians, ("symbol",), names, scopes, {"ridge": ridge_alpha}), "fits")
        known = evaluation_rows.where(F.col(target).isNotNull())
        parts.append(
            known.join(table.where("train_rows > 0"), "symbol").select(
                "symbol",
                F.lit(target).alias("target"),
                "scope",
                "date",
                "decision_time_ns",
                F.col(target).alias("actual"),
                F.expr(linear.linear_score(names)).alias("predicted"),
                "training_mean",
                "train_rows",
            )
        )
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def placebo_predictions(
    train: DataFrame, evaluation_rows: DataFrame, sets: FeatureSets, target: str,
    ridge_alpha: float, shift_rows: int,
) -> DataFrame:
    """The expanded ridge with its added columns rotated within each day."""
    groups, order = ("symbol", "date"), "decision_time_ns"

    def shifted(frame: DataFrame) -> DataFrame:
        known = frame.where(F.col(target).isNotNull())
        return evaluation.circular_shift(known, groups, sets.additions, shift_rows, order)

    predictions = fixed_split_predictions(
        shifted(train), shifted(evaluation_rows), sets, [target], ridge_alpha
    )
    return predictions.where("scope = 'expanded'")


def logistic_predictions(
    features: DataFrame, folds: DataFrame, sets: FeatureSets, label: str,
    inverse_penalty: float, purge_seconds: int, iterations: int = 200,
) -> tuple[DataFrame, DataFrame]:
    """Probabilities per symbol, fold and scope, and the fits without a result.

    All fits of the run advance together, one pass over the training rows per Newton step. A fold with an
    empty or overlapping side raises.
    """
    splits.require_split(features, folds, purge_seconds)
    names = sets.expanded
    train = stored(
        splits.training_folds(features.where(F.col(label).isNotNull()), folds, purge_seconds).select("symbol", "folds", label, *names),
        "training-rows",
    )
    tables = linear.scaling(
        _fold_sums(features, folds, names, label, purge_seconds),
        _fold_medians(features, folds, names, label, purge_seconds), ("symbol", "fold"), names,
    )
    scaling = {  # three numbers for each feature of a fit
        (r["symbol"], r["fold"]): dict(zip(r["names"], zip(r["median"], r["mean"], r["deviation"])))
        for r in tables.collect()
    }
    scopes = {"baseline": sets.baseline, "expanded": names}
    failures, complete = [], {}
    for (symbol, fold), table in scaling.items():
        if set(table) == set(names):
            complete[(symbol, fold)] = table
        else:
            missing = sorted(set(names) - set(table))
            failures.append((symbol, fold, "EmptyFeature", f"no training values: {missing}"))
    fitted = linear.logistic_fits(
        train, "symbol", names, scopes, label, inverse_penalty, complete, iterations
    )
    fits = {
        (symbol, fold, "logistic", scope): linear.raw_scale_fit(
            weights, scopes[scope], names, complete[(symbol, fold)]
        )
        for (symbol, fold, scope), weights in fitted.items()
    }
    table = linear.fits_table(features, fits, "symbol string, fold int, model string, scope string")
    score = f"1.0D / (1.0D + exp(-({linear.linear_score(names)})))"
    split = splits.walk_forward_split(features, folds, purge_seconds)
    predictions = split.where((F.col("role") == "evaluate") & F.col(label).isNotNull()).join(table, ["symbol", "fold"]).select(
        *PREDICTION_KEYS, "date", "decision_time_ns", F.col(label).alias("actual"),
        F.expr(score).alias("predicted"),
    )
    schema = "symbol string, fold int, error_type string, message string"
    return predictions, features.sparkSession.createDataFrame(failures, schema)


def _known_rows(frame: DataFrame, target: str) -> dict[str, int]:
    """Rows of each symbol with a known target."""
    return {r["symbol"]: r["count"] for r in frame.where(F.col(target).isNotNull()).groupBy("symbol").count().collect()}


def tree_search(
    train: DataFrame, validation: DataFrame, features: Sequence[str], target: str,
    grid: Sequence[trees.TreeParams],
) -> DataFrame:
    """Validation loss of every (symbol, candidate); one that cannot be grown has its error instead of a loss.

    All symbols and depths grow together, and candidates that differ in their number of trees share a fit. A
    failed job is not a failed candidate: it stops the query. A symbol without rows on either side, or without any
    candidate that can be grown, raises.
    """
    sizes, held = _known_rows(train, target), _known_rows(validation, target)
    if not sizes or set(sizes) != set(held):
        raise ValueError(f"empty side of the tuning split: training {sorted(sizes)}, validation {sorted(held)}")
    problems = {p: p.problem() for p in grid}
    if all(problems.values()):
        raise RuntimeError(f"every candidate failed: {next(iter(problems.values()))}")
    sound = trees.shared_fits([p for p in grid if not problems[p]])
    training = trees.binned(train, features, target, "symbol", ("symbol", "decision_time_ns"))
    wanted = [(symbol, same) for symbol in sorted(sizes) for same in sound]
    models = trees.grown(training, [(symbol, same[0]) for symbol, same in wanted])
    scored = trees.losses(
        validation, features, target, "symbol",
        [(symbol, model, [p.n_estimators for p in same]) for (symbol, same), model in zip(wanted, models)],
    )
    rows = [
        (symbol, p.max_depth, p.n_estimators, sizes[symbol], held[symbol], scored[i, p.n_estimators], None, None)
        for i, (symbol, same) in enumerate(wanted)
        for p in same
    ]
    rows += [
        (symbol, p.max_depth, p.n_estimators, sizes[symbol], held[symbol], None, "ValueError", problem)
        for symbol in sorted(sizes)
        for p, problem in problems.items()
        if problem
    ]
    return train.sparkSession.createDataFrame(
        rows,
        "symbol string, max_depth int, n_estimators int, train_rows long, validation_rows long, "
        "validation_mse double, error_type string, message string",
    )


def chosen_trees(scores: DataFrame) -> dict[str, trees.TreeParams]:
    """The candidate of each symbol with the smallest loss, then fewer trees, then less depth."""
    order = F.struct("validation_mse", "n_estimators", "max_depth")
    best = scores.where("validation_mse IS NOT NULL").groupBy("symbol").agg(F.min(order).alias("best"))
    return {
        r["symbol"]: trees.TreeParams(max_depth=r["best"]["max_depth"], n_estimators=r["best"]["n_estimators"])
        for r in best.collect()
    }


def tree_holdout(
    train: DataFrame, evaluation_rows: DataFrame, features: Sequence[str], target: str,
    params: Mapping[str, trees.TreeParams], stride_ns: int = 1,
) -> DataFrame:
    """Trees of each symbol fitted on every training row with a known target, scored on the holdout.

    Fits are not made on a sample: ``stride_ns`` is kept for callers that pass 1, every row, and any other raises.
    A symbol of the holdout without candidate or training rows raises.
    """
    if stride_ns != 1:
        raise ValueError(f"trees are fitted on every training row, not on a stride of {stride_ns} ns")
    known = train.where(F.col(target).isNotNull())
    symbols = sorted(_known_rows(evaluation_rows, target))
    if missing := set(symbols) - (set(params) & set(_known_rows(known, target))):
        raise ValueError(f"no trees for {sorted(missing)}")
    means = known.groupBy("symbol").agg(F.avg(target).alias("training_mean"))
    rows = evaluation_rows.where(F.col(target).isNotNull())
    own = known.where(F.col("symbol").isin(symbols))
    training = trees.binned(own, features, target, "symbol", ("symbol", "decision_time_ns"))
    models = dict(zip(symbols, trees.grown(training, [(s, params[s]) for s in symbols])))
    scored = trees.score(rows, features, "symbol", models).withColumn("actual", F.col(target))
    return scored.join(means, "symbol")
