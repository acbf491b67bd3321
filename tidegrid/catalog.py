"""The registered queries: every operator applied to the given tables.

The ``events`` table is read as two trade streams of two symbols (``sources.trades``). Its
days are thin, so the grid is coarse; all spans are parameters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions.guards import rounded
from tidegrid.functions.ordering import exact_median
from tidegrid.operators import asof, bars, evaluation, fills, inference, ledger, linear, quality, splits, trees
from tidegrid.operators.flow import label_names, predictor_names
from tidegrid.params import DAY_NS, MARKETS, NS_PER_MS, ExecutionParams, FeatureSets, GridParams
from tidegrid.plans import backtest, features as feature_plans, models, research
from tidegrid.session import scratch_path, stored, use_utc
from tidegrid.sources import archives, tables
from tidegrid.sources import trades as trade_source
from tidegrid.streaming import bars as stream

HOUR_MS = 3_600_000
GRID = GridParams(
    base_interval_ms=900_000,
    decision_interval_ms=HOUR_MS,
    windows_ms=(900_000, 1_800_000, HOUR_MS, 2 * HOUR_MS, 4 * HOUR_MS),
    label_horizons_ms=(HOUR_MS, 2 * HOUR_MS, 4 * HOUR_MS),
    basis_z_window_ms=4 * HOUR_MS,
    feature_lag_bars=1,
)
SETS = FeatureSets(short_ms=HOUR_MS, long_ms=2 * HOUR_MS, z_ms=4 * HOUR_MS)
EXECUTION = ExecutionParams(
    latencies_ms=(60_000, 300_000, 600_000, 900_000, 1_800_000),
    primary_latency_ms=300_000,
    holding_seconds=3_600,
    daily_loss_limit=0.5,
)
SYMBOLS = ("AAA", "BBB")
TARGET = f"target_spot_log_return_{HOUR_MS}ms"
DIRECTION = f"target_spot_direction_{HOUR_MS}ms"
PERIODS = (
    ("development", "2024-01-01", "2024-01-15", "open"),
    ("confirmation", "2024-01-16", "2024-01-24", "open"),
    ("holdout", "2024-01-25", "2024-01-30", "open"),
)
SEALED = (*PERIODS[:2], (*PERIODS[2][:3], "sealed"))
INITIAL_DAYS, EVALUATION_DAYS = 10, 5
PURGE_SECONDS = 7_200
STRIDE_NS = 2 * HOUR_MS * NS_PER_MS
PLACEBO_ROWS = 900
BOOTSTRAP = {"replicates": 2_000, "seed": 20240101}
RIDGE_ALPHA = 1.0
TREE_GRID = trees.tree_grid()
TUNING_BOUNDARY = "2024-01-11"
VOLATILITY = f"spot_realised_volatility_{2 * HOUR_MS}ms"

Query = Callable[[SparkSession, str], DataFrame]
_written: dict = {}


def forget(*names: str) -> None:
    """Drop the references to stored stages (all without names); the next query writes its own."""
    for key in [k for k in _written if not names or k[2] in names]:
        del _written[key]


def _once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A pipeline stage stored as a table, shared by the queries of one session."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _written:
        _written[key] = stored(make(), name)
    return _written[key]


def _trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trade_source.event_trades(spark, sf_dir)


def dense_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as a larger trade stream over about 2,500 days, for throughput tests."""
    use_utc(spark)
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(
        "CASE WHEN l_suppkey % 2 = 0 THEN 'AAA' ELSE 'BBB' END AS symbol",
        "CASE WHEN l_linenumber % 2 = 0 THEN 'spot' ELSE 'perpetual' END AS market_type",
        "CAST(CAST(l_shipdate AS DATE) AS STRING) AS date",
        "(unix_date(CAST(l_shipdate AS DATE)) * 86400 + l_orderkey % 86400) * 1000000000 AS event_time_ns",
        "CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS aggregate_trade_id",
        "l_extendedprice / l_quantity AS price",
        "CAST(l_quantity AS DOUBLE) AS quantity",
        "l_linenumber % 3 = 0 AS is_buyer_maker",
    )
    return trade_source.with_flow_columns(lines)


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(
        spark, sf_dir, "features", lambda: feature_plans.feature_frame(_trades(spark, sf_dir), GRID)
    )


# Deterministic scores of the features stand in for model output where results are compared
# with SQL, so that no fitted number enters.
_SPOT = f"0.5D * spot_quantity_imbalance_{HOUR_MS}ms + 0.1D * coalesce(spot_log_return_{HOUR_MS}ms, 0.0D)"
_BOTH = f"{_SPOT} + 0.2D * perpetual_quantity_imbalance_{HOUR_MS}ms"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(
        spark,
        sf_dir,
        "scored",
        lambda: _features(spark, sf_dir).selectExpr(
            "symbol",
            "date",
            "decision_time_ns",
            f"{TARGET} AS actual",
            f"CAST({DIRECTION} AS INT) AS direction_label",
            f"round({_SPOT}, 9) AS baseline",
            f"round({_BOTH}, 9) AS expanded",
            f"round(0.5D + 0.4D * spot_quantity_imbalance_{HOUR_MS}ms, 9) AS probability",
            f"spot_realised_volatility_{2 * HOUR_MS}ms AS volatility",
        ),
    )


def _between(frame: DataFrame, *names: str) -> DataFrame:
    inside = F.lit(False)
    for name, start, end, _ in PERIODS:
        if name in names:
            inside = inside | F.col("date").between(start, end)
    return frame.where(inside)


def _with_training_mean(scored: DataFrame) -> DataFrame:
    """Rounded targets with the development mean of each symbol.

    Targets are rounded so that ties are the same in every engine.
    """
    known = scored.where("actual IS NOT NULL").withColumn("actual", F.round("actual", 9))
    means = _between(known, "development").groupBy("symbol").agg(F.avg("actual").alias("training_mean"))
    return known.join(means, "symbol")


def _predictions(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    return _with_training_mean(_scored(spark, sf_dir)).withColumn("predicted", F.col(column))


def _probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).where("direction_label IS NOT NULL").select(
        "symbol",
        "date",
        "decision_time_ns",
        F.col("direction_label").alias("actual"),
        F.col("probability").alias("predicted"),
    )


def _folds(frame: DataFrame) -> DataFrame:
    return splits.expanding_folds(frame, INITIAL_DAYS, EVALUATION_DAYS)


def _scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long predictions of both deterministic scores."""
    both = F.array(
        *(
            F.struct(F.lit(name).alias("scope"), F.col(name).alias("predicted"))
            for name in ("baseline", "expanded")
        )
    )
    return _with_training_mean(_scored(spark, sf_dir)).select(
        "symbol", "date", "decision_time_ns", "actual", "training_mean", F.inline(both)
    )


def _fold_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same predictions on evaluation rows, with the training mean of each fold."""
    scored = _scored(spark, sf_dir).where("actual IS NOT NULL").withColumn("actual", F.round("actual", 9))
    split = splits.walk_forward_split(scored, _folds(scored), PURGE_SECONDS)
    means = research.fold_training_mean(split, "actual")
    both = F.array(
        *(
            F.struct(F.lit(name).alias("scope"), F.col(name).alias("predicted"))
            for name in ("baseline", "expanded")
        )
    )
    rows = split.where("role = 'evaluate'").select(
        "symbol", "fold", "date", "decision_time_ns", "actual", F.inline(both)
    )
    return rows.join(means, ["symbol", "fold"]).withColumn("model", F.lit("score"))


def _backtest(spark: SparkSession, sf_dir: str) -> backtest.Backtest:
    key = (spark.sparkContext.applicationId, sf_dir, "backtest")
    if key not in _written:
        scored = _scored(spark, sf_dir).withColumnRenamed("baseline", "prediction").select(
            "symbol", "date", "decision_time_ns", "prediction", "volatility"
        )
        _written[key] = backtest.run_backtest(
            _trades(spark, sf_dir),
            _between(scored, "development"),
            _between(scored, "confirmation", "holdout"),
            EXECUTION,
        )
    return _written[key]


_SIGNAL_COLUMNS = (
    "symbol", "date", "decision_time_ns", "prediction", "volatility", "signal_threshold", "direction",
)
_FILL_COLUMNS = (
    "latency_ms", "entry_time_ns", "entry_price", "exit_time_ns", "exit_price", "gross_return",
    "holding_seconds",
)
_LEDGER_COLUMNS = (
    "symbol", "date", "latency_ms", "cost_bps", "decision_time_ns", "entry_time_ns", "exit_time_ns",
    "size", "gross_return", "gross_pnl", "cost_pnl", "net_pnl",
)


# --- A: sources and sinks -------------------------------------------------------------------


def ingest_archives(spark, sf_dir):
    raw = trade_source.raw_text_from_events(trade_source.read_events(spark, sf_dir))
    ingested = archives.ingest_archives(archives.pack_archives(raw))
    return trade_source.normalise_raw(ingested)


def verify_checksums(spark, sf_dir):
    raw = trade_source.raw_text_from_events(trade_source.read_events(spark, sf_dir))
    files = archives.pack_archives(raw)
    return archives.verify_checksums(files, _damaged(archives.sidecars_for(files)))


def _damaged(sidecars: DataFrame) -> DataFrame:
    """Sidecars as a transfer may leave them, by day of the month: altered, lost, unreadable, of another file, sound."""
    kind = F.regexp_extract("path", r"(\d{2})-\d{6}\.zip", 1).cast("int") % 5
    text = (
        F.when(kind == 1, F.concat(F.sha2("text", 256), F.substring("text", 65, 1_000)))
        .when(kind == 3, F.substring("text", 10, 1_000))
        .when(kind == 4, F.concat(F.substring("text", 1, 66), F.lit("other.zip\n")))
        .otherwise(F.col("text"))
    )
    return sidecars.where(kind != 2).withColumn("text", text)


def scan_trades(spark, sf_dir):
    return _trades(spark, sf_dir).select(
        "symbol", "market_type", "date", "event_time_ns", "aggregate_trade_id", "price", "quantity"
    )


def _stored_trades(spark, sf_dir) -> str:
    path = scratch_path(spark, "trades")
    tables.write_trades(_trades(spark, sf_dir), path)
    return path


def write_trades(spark, sf_dir):
    return tables.read_trades(spark, _stored_trades(spark, sf_dir))


def partition_inventory(spark, sf_dir):
    return tables.partition_inventory(spark, _stored_trades(spark, sf_dir))


def physical_order(spark, sf_dir):
    """Stored files along their rows; those of the perpetual market's even days are written backwards."""
    path = scratch_path(spark, "disordered-trades")
    planted = (F.col("market_type") == "perpetual") & (F.substring("date", 9, 2).cast("int") % 2 == 0)
    order = [F.when(planted, -F.col(n)).otherwise(F.col(n)) for n in ("event_time_ns", "aggregate_trade_id")]
    tables.write_trades(_trades(spark, sf_dir), path, order=order)
    return quality.physical_order(tables.read_trades(spark, path), tables.TRADE_PARTITIONS)


def committed_trades(spark, sf_dir):
    """A table after a correction: even days are replaced by their trades with even ids, in one commit."""
    path, trades = scratch_path(spark, "committed-trades"), _trades(spark, sf_dir)
    tables.commit_trades(trades, path)
    tables.commit_trades(trades.where("CAST(substr(date, 9, 2) AS INT) % 2 = 0 AND aggregate_trade_id % 2 = 0"), path)
    return tables.read_committed_trades(spark, path)


def scan_features(spark, sf_dir):
    features = _features(spark, sf_dir)
    path = scratch_path(spark, "feature-table")
    tables.write_features(features, path)
    frame = tables.read_features(
        spark, path, SYMBOLS, PERIODS[1][1], PERIODS[1][2], [*SETS.expanded, TARGET], features.schema
    )
    return rounded(frame)


def missing_partitions(spark, sf_dir):
    trades = _trades(spark, sf_dir)
    expected = splits.observed_grid(trades, (*SYMBOLS, "CCC"), MARKETS)
    return splits.missing_partitions(expected, trades)


def selection_grid(spark, sf_dir):
    return splits.observed_grid(_trades(spark, sf_dir), SYMBOLS, MARKETS)


# --- B: projections, filters ----------------------------------------------------------------


def normalise_trades(spark, sf_dir):
    return trade_source.normalise_raw(
        trade_source.raw_text_from_events(trade_source.read_events(spark, sf_dir))
    )


def timestamp_units(spark, sf_dir):
    return trade_source.timestamp_units(
        trade_source.raw_text_from_events(trade_source.read_events(spark, sf_dir))
    )


def day_bounds_violations(spark, sf_dir):
    return trade_source.day_bounds_violations(_trades(spark, sf_dir))


def decision_sample(spark, sf_dir):
    frame = bars.base_bars(_trades(spark, sf_dir), GRID.base_ns)
    sample = feature_plans.decision_sample(frame, GRID).withColumn(
        "in_training_sample", F.pmod("decision_time_ns", F.lit(STRIDE_NS)) == 0
    )
    return rounded(sample)


def sample_periods(spark, sf_dir):
    labelled = splits.sample_periods(_trades(spark, sf_dir), SEALED)
    return labelled.groupBy("period", "period_status", "symbol").agg(
        F.count("*").alias("rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date")
    )


# --- C, D, E: bars and features -------------------------------------------------------------


def base_bars(spark, sf_dir):
    return rounded(bars.base_bars(_trades(spark, sf_dir), GRID.base_ns))


def two_market_bars(spark, sf_dir):
    return rounded(bars.market_bars(_trades(spark, sf_dir), GRID.base_ns))


def trade_flow_features(spark, sf_dir):
    return rounded(feature_plans.trade_flow_features(_trades(spark, sf_dir), GRID))


def realised_volatility(spark, sf_dir):
    return rounded(feature_plans.realised_volatility(_trades(spark, sf_dir), GRID))


def cross_market_features(spark, sf_dir):
    return rounded(feature_plans.cross_market_features(_trades(spark, sf_dir), GRID))


def basis_zscore(spark, sf_dir):
    return rounded(feature_plans.basis_zscore(_trades(spark, sf_dir), GRID))


def future_labels(spark, sf_dir):
    return rounded(feature_plans.future_labels(_trades(spark, sf_dir), GRID))


def feature_frame(spark, sf_dir):
    return rounded(feature_plans.feature_frame(_trades(spark, sf_dir), GRID))


def validate_trades(spark, sf_dir):
    keys = ("symbol", "market_type", "date")
    return quality.validate_trades(_trades(spark, sf_dir), keys, "aggregate_trade_id", SYMBOLS)


def duplicate_ids(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return quality.duplicate_ids(lines, ("l_orderkey", "l_linenumber"))


def validate_features(spark, sf_dir):
    return quality.validate_features(_features(spark, sf_dir), predictor_names(GRID), label_names(GRID))


def feature_summary(spark, sf_dir):
    return rounded(quality.feature_summary(_features(spark, sf_dir), TARGET, HOUR_MS))


def thinned_series(spark, sf_dir):
    columns = [f"{m}_quantity_imbalance_{HOUR_MS}ms" for m in MARKETS]
    return rounded(quality.thinned_series(_features(spark, sf_dir), columns, 6))


# --- D, E: evaluation -----------------------------------------------------------------------


def regression_metrics(spark, sf_dir):
    return rounded(evaluation.regression_metrics(_predictions(spark, sf_dir, "baseline"), ["symbol"]))


def classification_metrics(spark, sf_dir):
    return rounded(evaluation.classification_metrics(_probabilities(spark, sf_dir), ["symbol"]))


def daily_metrics(spark, sf_dir):
    groups = ["symbol", "date", "scope"]
    return rounded(evaluation.daily_regression_metrics(_scopes(spark, sf_dir), groups))


def daily_classification_metrics(spark, sf_dir):
    frame = _probabilities(spark, sf_dir)
    return rounded(evaluation.daily_classification_metrics(frame, ["symbol", "date"]))


def rank_ic(spark, sf_dir):
    return rounded(evaluation.rank_ic(_predictions(spark, sf_dir, "baseline")))


def deciles_floor(spark, sf_dir):
    frame = _predictions(spark, sf_dir, "baseline")
    return rounded(evaluation.deciles_floor(frame, ["symbol"], ["decision_time_ns"]))


def deciles_ntile(spark, sf_dir):
    frame = _predictions(spark, sf_dir, "baseline")
    return rounded(evaluation.deciles_equal(frame, ["symbol"], ["decision_time_ns"]))


def _paired(spark, sf_dir):
    daily = evaluation.daily_regression_metrics(_scopes(spark, sf_dir), ["symbol", "date", "scope"])
    return evaluation.paired_daily_loss(
        daily.where("scope = 'baseline'"), daily.where("scope = 'expanded'"), ["symbol", "date"]
    )


def paired_daily_loss(spark, sf_dir):
    return rounded(_paired(spark, sf_dir))


def day_bootstrap(spark, sf_dir):
    return rounded(inference.day_bootstrap(_paired(spark, sf_dir), "date", **BOOTSTRAP))


def regime_metrics(spark, sf_dir):
    frame = _predictions(spark, sf_dir, "baseline")
    cut = exact_median(_between(_scored(spark, sf_dir), "development"), ["symbol"], "volatility", "cut")
    tested = _between(frame, "confirmation", "holdout").join(cut, "symbol").withColumn(
        "regime", F.when(F.col("volatility") < F.col("cut"), "low").otherwise("high")
    )
    metrics = evaluation.regression_metrics(tested, ["symbol", "regime"])
    return rounded(metrics.join(cut.withColumnRenamed("cut", "development_threshold"), "symbol"))


def signal_thresholds(spark, sf_dir):
    scored = _scored(spark, sf_dir).withColumn("prediction", F.col("baseline"))
    calibration = _between(scored, "development")
    return rounded(backtest.signal_thresholds(calibration, EXECUTION.threshold_sigma))


def circular_shift(spark, sf_dir):
    known = _scored(spark, sf_dir).where("actual IS NOT NULL")
    frame = known.select("symbol", "date", "decision_time_ns", "baseline", "expanded")
    return evaluation.circular_shift(
        frame, ("symbol", "date"), ["expanded"], PLACEBO_ROWS, "decision_time_ns"
    )


def model_ranking(spark, sf_dir):
    metrics = evaluation.regression_metrics(_fold_scopes(spark, sf_dir), ["symbol", "fold", "model", "scope"])
    return rounded(evaluation.model_ranking(metrics))


def best_candidate(spark, sf_dir):
    """Weights of the imbalance as candidates, compared on the confirmation period."""
    frame = _between(_predictions(spark, sf_dir, "baseline"), "confirmation")
    weights = F.array(*(F.lit(w) for w in (0.0, 0.1, 0.5, 1.0)))
    error = F.col("actual") - F.col("weight") * F.col("predicted")
    candidates = frame.withColumn("weight", F.explode(weights)).groupBy("weight").agg(
        F.round(F.avg(error * error), 8).alias("validation_mse"), F.count("*").alias("validation_rows")
    )
    return evaluation.best_candidate(candidates, ["validation_mse", "weight"])


def model_selection(spark, sf_dir):
    frame = _scopes(spark, sf_dir)
    overall = evaluation.regression_metrics(frame, ["scope"])
    wide = overall.agg(
        F.max(F.when(F.col("scope") == "baseline", F.col("oos_r2"))).alias("incumbent_r2"),
        F.max(F.when(F.col("scope") == "expanded", F.col("oos_r2"))).alias("candidate_r2"),
    )
    interval = inference.day_bootstrap(_paired(spark, sf_dir), "date", **BOOTSTRAP)
    return rounded(evaluation.model_selection(wide, interval, 0.001))


# --- H: splits and models -------------------------------------------------------------------


def walk_forward_folds(spark, sf_dir):
    return _folds(_trades(spark, sf_dir))


def walk_forward_split(spark, sf_dir):
    scored = _scored(spark, sf_dir)
    split = splits.walk_forward_split(scored, _folds(scored), PURGE_SECONDS)
    return split.groupBy("fold", "role", "symbol").agg(
        F.count("*").alias("rows"),
        F.min("decision_time_ns").alias("first_decision_time_ns"),
        F.max("decision_time_ns").alias("last_decision_time_ns"),
    )


def reference_predictions(spark, sf_dir):
    scored = _scored(spark, sf_dir)
    split = splits.walk_forward_split(scored, _folds(scored), PURGE_SECONDS)
    frame = research.reference_predictions(split, "actual")
    error = F.col("actual") - F.col("predicted")
    return rounded(
        frame.groupBy("symbol", "fold", "model").agg(
            F.count("*").alias("rows"),
            F.avg("predicted").alias("prediction"),
            F.avg(error * error).alias("mse"),
        )
    )


def train_only_scaling(spark, sf_dir):
    features = _features(spark, sf_dir).where(F.col(TARGET).isNotNull())
    split = splits.walk_forward_split(features, _folds(features), PURGE_SECONDS)
    train = split.where("role = 'train'")
    return rounded(linear.train_scaling(train, ("symbol", "fold"), SETS.expanded), 6)


_X1 = f"spot_quantity_imbalance_{HOUR_MS}ms"
_X2 = f"perpetual_quantity_imbalance_{HOUR_MS}ms"


def ols_two_feature(spark, sf_dir):
    frame = _features(spark, sf_dir)
    return rounded(linear.two_feature_regression(frame, ["symbol"], _X1, _X2, TARGET))


def ridge_two_feature(spark, sf_dir):
    frame = _features(spark, sf_dir)
    return rounded(linear.two_feature_regression(frame, ["symbol"], _X1, _X2, TARGET, 25.0))


def hac_regression(spark, sf_dir):
    """One regressor; p-values are left to the full query, SQL has no normal distribution."""
    sampled = _features(spark, sf_dir).where(F.pmod("decision_time_ns", F.lit(STRIDE_NS)) == 0)
    return rounded(inference.hac_regression(sampled, "symbol", [_X1], TARGET, 12).drop("p_value"), 6)


def hac_regression_expanded(spark, sf_dir):
    sampled = _features(spark, sf_dir).where(F.pmod("decision_time_ns", F.lit(STRIDE_NS)) == 0)
    return rounded(inference.hac_regression(sampled, "symbol", SETS.hac_expanded, TARGET, 12), 6)


def _linear(spark, sf_dir) -> DataFrame:
    features = _features(spark, sf_dir)
    return research.linear_predictions(
        features, _folds(features), SETS, TARGET, RIDGE_ALPHA, PURGE_SECONDS
    )


def linear_walk_forward(spark, sf_dir):
    return rounded(_linear(spark, sf_dir))


def _logistic(spark, sf_dir):
    features = _features(spark, sf_dir)
    folds = _folds(features)
    return research.logistic_predictions(features, folds, SETS, DIRECTION, 1.0, PURGE_SECONDS)


def logistic_walk_forward(spark, sf_dir):
    predictions, _ = _logistic(spark, sf_dir)
    return rounded(predictions, 6)


def walk_forward_metrics(spark, sf_dir):
    """All models of the walk-forward run: regression and classification, every fold and scope."""
    features = _features(spark, sf_dir)
    split = splits.walk_forward_split(features, _folds(features), PURGE_SECONDS)
    reference = research.reference_predictions(split, TARGET)
    keys = list(research.PREDICTION_KEYS)
    columns = [*keys, "date", "decision_time_ns", "actual", "predicted", "training_mean"]
    values = stored(
        _linear(spark, sf_dir).select(*columns).unionByName(reference.select(*columns)), "predictions"
    )
    chances = stored(_logistic(spark, sf_dir)[0], "probabilities")
    regression = evaluation.regression_metrics(values, keys).withColumn("task", F.lit("regression"))
    classes = evaluation.classification_metrics(chances, keys).withColumn("task", F.lit("classification"))
    return rounded(regression.unionByName(classes, allowMissingColumns=True), 6)


def placebo_ridge(spark, sf_dir):
    features = _features(spark, sf_dir)
    predictions = research.placebo_predictions(
        _between(features, "development"), _between(features, "confirmation"), SETS, TARGET,
        RIDGE_ALPHA, PLACEBO_ROWS,
    )
    return rounded(evaluation.regression_metrics(predictions, ["symbol"]), 6)


def horizon_metrics(spark, sf_dir):
    features = _features(spark, sf_dir)
    targets = [f"target_spot_log_return_{h}ms" for h in GRID.label_horizons_ms]
    predictions = research.fixed_split_predictions(
        _between(features, "development"), _between(features, "confirmation"), SETS, targets, RIDGE_ALPHA
    )
    return rounded(evaluation.regression_metrics(predictions, ["symbol", "target", "scope"]), 6)


def _tree_search(spark, sf_dir) -> DataFrame:
    def make():
        development = _between(_features(spark, sf_dir), "development")
        train, validation = splits.boundary_split(development, TUNING_BOUNDARY, PURGE_SECONDS)
        return research.tree_search(train, validation, SETS.expanded, TARGET, TREE_GRID)

    return _once(spark, sf_dir, "tree_search", make)


def gbt_grid_search(spark, sf_dir):
    """Every candidate of each symbol, failed ones with their error."""
    return rounded(_tree_search(spark, sf_dir))


def gbt_holdout(spark, sf_dir):
    """Trees chosen and fitted on development, scored on confirmation."""
    features = _features(spark, sf_dir)
    frame = research.tree_holdout(
        _between(features, "development"), _between(features, "confirmation"), SETS.expanded, TARGET,
        research.chosen_trees(_tree_search(spark, sf_dir)),
    )
    return rounded(frame.select("symbol", "date", "decision_time_ns", "actual", "predicted"))


def _holdout(spark, sf_dir) -> DataFrame:
    """Trees chosen on development, refitted on development and confirmation, scored on the holdout once."""

    def make():
        features = _features(spark, sf_dir)
        frame = research.tree_holdout(
            _between(features, "development", "confirmation"), _between(features, "holdout"),
            SETS.expanded, TARGET, research.chosen_trees(_tree_search(spark, sf_dir)),
        )
        volatility = F.col(VOLATILITY).alias("volatility")
        return frame.select("symbol", "date", "decision_time_ns", "actual", "predicted", "training_mean", volatility)

    return _once(spark, sf_dir, "holdout", make)


def holdout_evaluation(spark, sf_dir):
    """Predictive metrics of the holdout, overall and per day."""
    scored = _holdout(spark, sf_dir).drop("volatility")
    overall = evaluation.regression_metrics(scored, ["symbol"]).withColumn("date", F.lit("all"))
    daily = evaluation.daily_regression_metrics(scored, ["symbol", "date"])
    return rounded(overall.unionByName(daily), 6)


def holdout_deciles(spark, sf_dir):
    """Mean outcome by decile of the holdout predictions."""
    return rounded(evaluation.deciles_equal(_holdout(spark, sf_dir), ["symbol"], ["decision_time_ns"]))


def holdout_economics(spark, sf_dir):
    """The holdout predictions traded at the threshold carried from development, with what was skipped."""
    limits = models.tree_thresholds(
        _between(_features(spark, sf_dir), "development"), SETS.expanded, TARGET, research.chosen_trees(_tree_search(spark, sf_dir)),
        TUNING_BOUNDARY, PURGE_SECONDS, 1, EXECUTION.threshold_sigma, VOLATILITY,
    )
    scored = _holdout(spark, sf_dir).withColumnRenamed("predicted", "prediction")
    run = backtest.run_signals(_trades(spark, sf_dir), scored, limits, EXECUTION)
    trades = backtest.primary_trades(run)
    metrics = ledger.performance_metrics(trades, _primary_daily(run, trades), ["symbol"], EXECUTION.annualisation_days)
    skipped = fills.execution_diagnostics(run.statuses, EXECUTION.primary_latency_ms).where(
        (F.col("sizing") == "fixed") & (F.col("latency_ms") == EXECUTION.primary_latency_ms)
    ).select("symbol", "skipped_entries", "skipped_exits")
    return rounded(metrics.join(skipped, "symbol", "left").join(limits.select("symbol", "signal_threshold"), "symbol"))


# --- B, C, I: fills and ledgers -------------------------------------------------------------


def signals(spark, sf_dir):
    return rounded(_backtest(spark, sf_dir).signals.select(*_SIGNAL_COLUMNS))


def _model_run(spark, sf_dir) -> backtest.Backtest:
    key = (spark.sparkContext.applicationId, sf_dir, "model-backtest")
    if key not in _written:
        features = _features(spark, sf_dir)
        fitted = models.ridge_models(
            _between(features, "development"), SETS.expanded, TARGET, RIDGE_ALPHA, TUNING_BOUNDARY, PURGE_SECONDS,
            EXECUTION.threshold_sigma, VOLATILITY,
        )
        predicted = models.ridge_predictions(
            fitted, _between(features, "confirmation", "holdout"), SETS.expanded, TARGET, VOLATILITY
        )
        _written[key] = backtest.run_signals(_trades(spark, sf_dir), stored(predicted, "model-predictions"), fitted, EXECUTION)
    return _written[key]


def model_signals(spark, sf_dir):
    """Signals of a ridge fitted on development, at the threshold of its out-of-sample predictions there."""
    return rounded(_model_run(spark, sf_dir).signals.select(*_SIGNAL_COLUMNS))


def model_backtest(spark, sf_dir):
    """Performance of the ridge signals at the primary latency and the reference cost."""
    run = _model_run(spark, sf_dir)
    trades = backtest.primary_trades(run)
    return rounded(
        ledger.performance_metrics(trades, _primary_daily(run, trades), ["symbol"], EXECUTION.annualisation_days)
    )


def sized_signals(spark, sf_dir):
    run = _backtest(spark, sf_dir)
    return rounded(
        fills.sized_signals(run.signals, EXECUTION).select(*_SIGNAL_COLUMNS, "sizing", "size")
    )


def asof_forward_fill(spark, sf_dir):
    """First spot trade at or after every decision plus the primary latency."""
    requests = _scored(spark, sf_dir).select("symbol", "date", "decision_time_ns").withColumn(
        "target_ns", F.col("decision_time_ns") + EXECUTION.primary_latency_ms * NS_PER_MS
    )
    index = fills.spot_index(_trades(spark, sf_dir))
    return asof.first_at_or_after(requests, index, "target_ns", "fill")


def candidate_fills(spark, sf_dir):
    run = _backtest(spark, sf_dir)
    frame = fills.candidate_fills(
        run.signals, fills.spot_index(_trades(spark, sf_dir)), EXECUTION.latencies_ms, EXECUTION.holding_seconds
    )
    return rounded(frame.select(*_SIGNAL_COLUMNS, *_FILL_COLUMNS))


def non_overlapping_trades(spark, sf_dir):
    statuses = _backtest(spark, sf_dir).statuses
    taken = statuses.where("status = 'taken'")
    return rounded(taken.select(*_SIGNAL_COLUMNS, *_FILL_COLUMNS))


def execution_diagnostics(spark, sf_dir):
    statuses = _backtest(spark, sf_dir).statuses
    return fills.execution_diagnostics(statuses, EXECUTION.primary_latency_ms)


def apply_cost(spark, sf_dir):
    run = _backtest(spark, sf_dir)
    costed = fills.apply_cost(run.trades, EXECUTION.cost_grid_bps)
    return rounded(costed.select("sizing", *_LEDGER_COLUMNS))


def _primary_daily(run: backtest.Backtest, trades: DataFrame) -> DataFrame:
    return ledger.daily_pnl(trades, run.thresholds.select("symbol"), run.dates, ["symbol"])


def daily_pnl(spark, sf_dir):
    run = _backtest(spark, sf_dir)
    return rounded(_primary_daily(run, backtest.primary_trades(run)))


def drawdown(spark, sf_dir):
    run = _backtest(spark, sf_dir)
    daily = _primary_daily(run, backtest.primary_trades(run))
    return rounded(ledger.equity_curve(daily, ["symbol"]))


def performance_metrics(spark, sf_dir):
    run = _backtest(spark, sf_dir)
    trades = backtest.primary_trades(run)
    daily = _primary_daily(run, trades)
    return rounded(
        ledger.performance_metrics(trades, daily, ["symbol"], EXECUTION.annualisation_days)
    )


def risk_weights(spark, sf_dir):
    run = _backtest(spark, sf_dir)
    return rounded(ledger.risk_weights(run.thresholds).select("symbol", "median_volatility", "weight"))


def portfolio_candidates(spark, sf_dir):
    run = _backtest(spark, sf_dir)
    candidates = backtest.weighted_candidates(run, [EXECUTION.reference_cost_bps])
    return rounded(candidates.select(*_LEDGER_COLUMNS))


def portfolio_ledger(spark, sf_dir):
    run = _backtest(spark, sf_dir)
    return rounded(backtest.portfolio(run, EXECUTION.cost_grid_bps).select(*_LEDGER_COLUMNS))


def sensitivity_grid(spark, sf_dir):
    return rounded(backtest.sensitivity_grid(_backtest(spark, sf_dir)))


def pnl_reconciliation(spark, sf_dir):
    run = _backtest(spark, sf_dir)
    trades = stored(backtest.scenario_trades(run), "scenarios")
    daily = ledger.daily_pnl(trades, backtest.scenario_entities(run), run.dates, backtest.SCENARIO)
    return rounded(ledger.pnl_reconciliation(trades, daily, backtest.SCENARIO))


def regime_performance(spark, sf_dir):
    """Performance of primary trades by the volatility regime of their signal."""
    run = _backtest(spark, sf_dir)
    keys = ["symbol", "regime"]
    regime = F.when(F.col("volatility") < F.col("median_volatility"), "low").otherwise("high")
    trades = backtest.primary_trades(run).withColumn("regime", regime)
    entities = run.thresholds.select(
        "symbol", F.explode(F.array(F.lit("low"), F.lit("high"))).alias("regime")
    )
    daily = ledger.daily_pnl(trades, entities, run.dates, keys)
    return rounded(ledger.performance_metrics(trades, daily, keys, EXECUTION.annualisation_days))


# --- J: streaming ---------------------------------------------------------------------------


def _stream_bars(spark, sf_dir) -> DataFrame:
    use_utc(spark)
    trades = stream.event_stream(spark, sf_dir, "events.parquet")
    return stream.run_to_table(stream.stream_bars(trades, GRID.base_interval_ms, "1 hour"), "bars")


def stream_bars(spark, sf_dir):
    return rounded(_stream_bars(spark, sf_dir))


def stream_bars_filled(spark, sf_dir):
    """Gap-free bars from two streams, the second reading the first's table; a tick ends the last day in both."""
    use_utc(spark)
    last = _trades(spark, sf_dir).agg(F.max("event_time_ns")).first()[0]
    if last is None:
        last = 0
    close = (last // DAY_NS + 1) * DAY_NS + 2 * HOUR_MS * NS_PER_MS
    clock = stream.write_clock(spark, close)
    trades = stream.with_clock(stream.event_stream(spark, sf_dir, "events.parquet"), clock, "event_time_ns")
    path = scratch_path(spark, "bar-table")
    stream.run_to_table(stream.stream_bars(trades, GRID.base_interval_ms, "1 hour"), "bars").write.parquet(path)
    bars_read = stream.with_clock(stream.bar_stream(spark, path), clock, "decision_time_ns")
    filled = stream.run_to_table(stream.fill_stream(bars_read, GRID.base_interval_ms), "filled")
    return rounded(stream.on_time(filled))


QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in (
        ingest_archives, verify_checksums, scan_trades, write_trades, committed_trades, physical_order,
        partition_inventory,
        scan_features, missing_partitions, selection_grid,
        normalise_trades, timestamp_units, day_bounds_violations, decision_sample, sample_periods,
        base_bars, two_market_bars, trade_flow_features, realised_volatility,
        cross_market_features, basis_zscore, future_labels, feature_frame,
        validate_trades, duplicate_ids, validate_features, feature_summary, thinned_series,
        regression_metrics, classification_metrics, daily_metrics, daily_classification_metrics,
        rank_ic, deciles_floor, deciles_ntile, paired_daily_loss, day_bootstrap, regime_metrics,
        signal_thresholds, circular_shift, model_ranking, best_candidate, model_selection,
        walk_forward_folds, walk_forward_split, reference_predictions, train_only_scaling,
        ols_two_feature, ridge_two_feature, hac_regression, hac_regression_expanded,
        linear_walk_forward, logistic_walk_forward, walk_forward_metrics, placebo_ridge,
        horizon_metrics, gbt_grid_search, gbt_holdout, holdout_evaluation, holdout_deciles, holdout_economics,
        signals, model_signals, model_backtest, sized_signals, asof_forward_fill, candidate_fills, non_overlapping_trades,
        execution_diagnostics, apply_cost, daily_pnl, drawdown, performance_metrics, risk_weights,
        portfolio_candidates, portfolio_ledger, sensitivity_grid, pnl_reconciliation,
        regime_performance, stream_bars, stream_bars_filled,
    )
}
