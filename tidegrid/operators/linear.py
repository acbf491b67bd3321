"""Linear, ridge and logistic models fitted from distributed sums.

Imputation and scaling are fitted on training rows only. Cross products are additive over
days, so one pass over the table serves every fold of a walk-forward run.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.ordering import exact_medians
from tidegrid.operators.splits import date_to_ns


#: A deviation below this share of the mean is what rounding leaves of a constant in sums of squares.
RESOLUTION = 1e-7


@dataclass(frozen=True)
class LinearFit:
    """Coefficients on raw features after median imputation, and the training mean."""

    medians: tuple[float, ...]
    intercept: float
    weights: tuple[float, ...]
    training_mean: float
    train_rows: int


def train_medians(train: DataFrame, groups: Sequence[str], features: Sequence[str]) -> DataFrame:
    """(groups, filling): a map from feature to training median; features without any value are not in it."""
    pairs = F.collect_list(F.struct("name", "median"))
    return exact_medians(train, groups, features).groupBy(*groups).agg(F.map_from_entries(pairs).alias("filling"))


def train_scaling(train: DataFrame, groups: Sequence[str], features: Sequence[str]) -> DataFrame:
    """(groups, name, median, mean, deviation): imputation and scaling fitted on training rows.

    Missing values count as the median; the deviation is the population one.
    """
    medians = exact_medians(train, groups, features)
    present = F.array(
        *(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in features)
    )
    keys = [*groups, "name"]
    moments = train.select(*groups, F.inline(present)).groupBy(*keys).agg(
        F.count("*").alias("_all"),
        F.count("value").alias("_known"),
        F.coalesce(F.sum("value"), F.lit(0.0)).alias("_sum"),
        F.coalesce(F.var_pop("value"), F.lit(0.0)).alias("_var"),
    )
    missing = F.col("_all") - F.col("_known")
    mean = (F.col("_sum") + missing * F.col("median")) / F.col("_all")
    # Total variance of the known values and the block of imputed medians.
    known_mean = F.col("_sum") / F.greatest(F.col("_known"), F.lit(1))
    within = F.col("_known") * F.col("_var")
    between = F.col("_known") * (known_mean - mean) * (known_mean - mean)
    imputed = missing * (F.col("median") - mean) * (F.col("median") - mean)
    return moments.join(medians.drop("rows"), keys).select(
        *keys,
        "median",
        mean.alias("mean"),
        F.sqrt((within + between + imputed) / F.col("_all")).alias("deviation"),
    )


def matrix_sums(partials: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, m): sums of matrices (doubles as bytes) by key, each partition in one pass over its sorted rows.

    A task holds one running sum, however many partial matrices a key has.
    """
    names = [*keys, "m"]
    partials = partials.select(*names)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, kinds, out = None, None, None, []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names)

        for part in batches:
            kinds = [part.schema.field(n).type for n in names]
            for *now, m in zip(*(part.column(n).to_pylist() for n in names)):
                if now == key:
                    held += np.frombuffer(m)
                    continue
                if key is not None:
                    out.append((*key, held.tobytes()))
                key, held = now, np.frombuffer(m).copy()
            if len(out) > 256:
                yield batch()
                out = []
        if key is not None:
            out.append((*key, held.tobytes()))
            yield batch()

    return partials.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(add, partials.schema)


def products(
    frame: DataFrame, groups: Sequence[str], features: Sequence[str], targets: Sequence[str]
) -> DataFrame:
    """(groups, target, m): cross products over rows with a known target, as the bytes of a square matrix.

    The design holds 1, every feature with missing values as zero, an indicator per feature
    for missing values, and the target. Filling in any median later is then a linear change
    of these sums, so they do not depend on the training set. Each task reduces its batches to
    one small matrix per group; they meet in a shuffle.
    """
    names, width = list(features), 2 * len(features) + 2
    kinds = dict(frame.dtypes)
    schema = ", ".join(f"{g} {kinds[g]}" for g in groups) + ", target string, m binary"
    keys = list(groups)

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict = {}
        for batch in batches:
            for key, part in batch.groupby(keys):
                values = part[names].to_numpy(dtype=float)
                missing = np.isnan(values)
                design = np.column_stack(
                    [np.ones(len(part)), np.where(missing, 0.0, values), missing.astype(float)]
                )
                for target in targets:
                    y = part[target].to_numpy(dtype=float)
                    known = ~np.isnan(y)
                    x = np.column_stack([design[known], y[known]])
                    held = totals.setdefault((*key, target), np.zeros((width, width)))
                    held += x.T @ x
        if totals:
            rows = [(*key, m.tobytes()) for key, m in totals.items()]
            yield pd.DataFrame(rows, columns=[*keys, "target", "m"])

    narrow = frame.select(
        *groups, *(F.col(c).cast("double").alias(c) for c in dict.fromkeys((*names, *targets)))
    )
    return matrix_sums(narrow.mapInPandas(reduce, schema), [*keys, "target"])


def fold_products(daily: DataFrame, folds: DataFrame) -> DataFrame:
    """(symbol, fold, m): each fold's training sums, from sums per (symbol, date, late).

    The days of a symbol are added up once in order. A fold trains on consecutive days, so its sums are the
    running sums at its last day less those before its first; rows marked ``late`` (within the purge before
    midnight) are left out where that midnight is the fold's boundary. A task holds the running sums
    alone, one matrix of them leaves for each fold. A fold without training rows has a matrix of zeros.
    """
    spans = folds.where("role = 'train'").groupBy("fold").agg(
        F.min("date").alias("first"), F.max("date").alias("last"), F.min("boundary_ns").alias("boundary_ns")
    )
    at_boundary = date_to_ns(F.date_add(F.col("last"), 1).cast("string")) == F.col("boundary_ns")
    marks = F.inline(
        F.array(
            F.struct(F.col("first").alias("date"), F.lit(0).alias("at"), F.lit(-1.0).alias("sign")),
            # a day's early rows come at 1, its late ones at 3
            F.struct(F.col("last").alias("date"), F.when(at_boundary, 2).otherwise(4).alias("at"), F.lit(1.0).alias("sign")),
        )
    )
    asked = daily.select("symbol").distinct().crossJoin(spans).select("symbol", "fold", marks)
    given = daily.select("symbol", "date", F.when(F.col("late"), 3).otherwise(1).alias("at"), "m")
    events = given.unionByName(asked, allowMissingColumns=True)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol, running, waiting, width = None, None, [], 0

        def batch(rows):
            columns = list(zip(*rows))
            types = (pa.string(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], ["symbol", "fold", "m"])

        for part in batches:
            out = []
            for now, fold, sign, m in zip(*(part.column(c).to_pylist() for c in ("symbol", "fold", "sign", "m"))):
                if now != symbol:
                    out += [(symbol, f, np.zeros(width).tobytes()) for f in waiting]
                    symbol, running, waiting = now, None, []
                if m is not None:
                    sums = np.frombuffer(m)
                    width = len(sums)
                    running = sums.copy() if running is None else running + sums
                    out += [(symbol, f, np.zeros(width).tobytes()) for f in waiting]
                    waiting = []
                elif running is not None:
                    out.append((symbol, fold, (sign * running).tobytes()))
                elif sign > 0:  # no day so far: zeros, once their number is known
                    waiting.append(fold)
            if out:
                yield batch(out)

    ordered = events.repartition("symbol").sortWithinPartitions("symbol", "date", "at", "fold")
    return matrix_sums(ordered.mapInArrow(scan, "symbol string, fold int, m binary"), ["symbol", "fold"])


FITTED = (
    "model string, scope string, _medians array<double>, _intercept double, _weights array<double>, "
    "training_mean double, train_rows long"
)


def fitted(
    sums: DataFrame, medians: DataFrame, keys: Sequence[str], features: Sequence[str],
    scopes: Mapping[str, Sequence[str]], penalties: Mapping[str, float],
) -> DataFrame:
    """(keys, model, scope, fit): one row for each key, model and scope, solved where the sums lie.

    Weights stand for all features, zero for those outside a scope. Without training rows the fit is NULL and
    ``train_rows`` 0.
    """
    names = list(features)
    kinds = dict(sums.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", " + FITTED

    def solve_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for *key, m, filling in batch[[*keys, "m", "filling"]].itertuples(index=False):
                matrix = np.frombuffer(m).reshape(2 * len(names) + 2, -1)
                filling = dict(filling) if filling is not None else {}
                filling = {n: filling.get(n, 0.0) for n in names}
                for model, alpha in penalties.items():
                    for scope, chosen in scopes.items():
                        if matrix[0, 0] < 1:
                            rows.append((*key, model, scope, None, None, None, None, 0))
                            continue
                        fit = solve(matrix, names, chosen, filling, alpha)
                        weights = dict(zip(chosen, fit.weights))
                        wide = [float(weights.get(n, 0.0)) for n in names]
                        values = [filling[n] for n in names]
                        rows.append((*key, model, scope, values, fit.intercept, wide, fit.training_mean, fit.train_rows))
            names_out = [*keys, "model", "scope", "_medians", "_intercept", "_weights", "training_mean", "train_rows"]
            yield pd.DataFrame(rows, columns=names_out)

    return sums.join(medians, list(keys), "left").mapInPandas(solve_all, schema)


def scaling(sums: DataFrame, medians: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """(keys, train_rows, names, median, mean, deviation): imputation and scaling from the same sums.

    The arrays hold the features that have a training value, in the order of ``features``.
    """
    names = list(features)
    kinds = dict(sums.dtypes)
    head = ", ".join(f"{k} {kinds[k]}" for k in keys)
    schema = f"{head}, train_rows long, names array<string>, median array<double>, mean array<double>, deviation array<double>"

    def scale_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for *key, m, filling in batch[[*keys, "m", "filling"]].itertuples(index=False):
                matrix = np.frombuffer(m).reshape(2 * len(names) + 2, -1)
                filling = dict(filling) if filling is not None else {}
                have = [n for n in names if n in filling]
                gram, _ = imputed(matrix, names, have, filling)
                n = max(gram[0, 0], 1.0)
                mean = gram[0, 1:] / n
                spread = np.sqrt(np.maximum(np.diag(gram)[1:] / n - mean**2, 0.0))
                spread[spread < RESOLUTION * np.abs(mean)] = 0.0
                rows.append((*key, int(round(gram[0, 0])), have, [filling[h] for h in have], mean.tolist(), spread.tolist()))
            yield pd.DataFrame(rows, columns=[*keys, "train_rows", "names", "median", "mean", "deviation"])

    return sums.join(medians, list(keys), "left").mapInPandas(scale_all, schema)


def imputed(
    matrix: np.ndarray, names: Sequence[str], chosen: Sequence[str], medians: Mapping[str, float]
) -> tuple[np.ndarray, np.ndarray]:
    """Cross products of (1, chosen features with medians for missing values), and theirs with the target."""
    count = len(names)
    picked = [list(names).index(c) for c in chosen]
    # columns of the imputed design as combinations of the stored ones
    impute = np.zeros((2 * count + 1, len(picked) + 1))
    impute[0, 0] = 1.0
    for column, (source, name) in enumerate(zip(picked, chosen), start=1):
        impute[1 + source, column] = 1.0
        impute[1 + count + source, column] = medians[name]
    return impute.T @ matrix[:-1, :-1] @ impute, impute.T @ matrix[:-1, -1]


def solve(
    products: np.ndarray,
    names: Sequence[str],
    chosen: Sequence[str],
    medians: Mapping[str, float],
    ridge_alpha: float,
) -> LinearFit:
    """Least squares (alpha 0) or ridge on the chosen, imputed and standardised features."""
    gram, xy = imputed(products, names, chosen, medians)
    rows = gram[0, 0]
    mean, y_mean = gram[0, 1:] / rows, xy[0] / rows
    centred = gram[1:, 1:] - rows * np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(centred) / rows, 0.0))
    flat = scale <= RESOLUTION * np.abs(mean)
    scale[flat] = 1.0
    centred[flat, :] = centred[:, flat] = 0.0
    left = centred / np.outer(scale, scale) + ridge_alpha * np.eye(len(chosen))
    right = np.where(flat, 0.0, (xy[1:] - rows * mean * y_mean) / scale)
    weights = np.linalg.lstsq(left, right, rcond=None)[0] / scale
    return LinearFit(
        tuple(medians[c] for c in chosen), float(y_mean - mean @ weights), tuple(weights), float(y_mean), int(round(rows))
    )


def fits_table(frame: DataFrame, fits: Mapping[tuple, LinearFit], keys: str) -> DataFrame:
    """Fits as a table (one row each) to join with the rows they score."""
    rows = [
        (*key, list(f.medians), f.intercept, list(f.weights), f.training_mean, f.train_rows)
        for key, f in fits.items()
    ]
    schema = (
        f"{keys}, _medians array<double>, _intercept double, _weights array<double>, "
        "training_mean double, train_rows long"
    )
    return frame.sparkSession.createDataFrame(rows, schema)


def linear_score(features: Sequence[str]) -> str:
    """SQL text of a fit's prediction; constant columns and codegen, no Python per row."""
    terms = [
        f"_weights[{i}] * coalesce(CAST({name} AS DOUBLE), _medians[{i}])"
        for i, name in enumerate(features)
    ]
    return " + ".join(["_intercept", *terms])


def two_feature_regression(
    frame: DataFrame, groups: Sequence[str], x1: str, x2: str, y: str, ridge_alpha: float = 0.0
) -> DataFrame:
    """Closed-form (ridge) regression on two standardised features, in one aggregation."""
    known = frame.where(" AND ".join(f"{c} IS NOT NULL" for c in (x1, x2, y)))
    moments = known.groupBy(*groups).agg(
        F.count("*").alias("n"),
        F.avg(y).alias("my"),
        F.var_pop(x1).alias("v1"),
        F.var_pop(x2).alias("v2"),
        F.corr(x1, x2).alias("r"),
        F.covar_pop(x1, y).alias("c1"),
        F.covar_pop(x2, y).alias("c2"),
    )
    diagonal = f"(n * 1.0D + {float(ridge_alpha)}D)"
    determinant = f"({diagonal} * {diagonal} - n * r * n * r)"
    b1, b2 = "(n * c1 / sqrt(v1))", "(n * c2 / sqrt(v2))"
    return moments.selectExpr(
        *groups,
        "n AS rows",
        "my AS intercept",
        f"({diagonal} * {b1} - n * r * {b2}) / {determinant} AS coefficient_1",
        f"({diagonal} * {b2} - n * r * {b1}) / {determinant} AS coefficient_2",
    )


def logistic_fits(
    train: DataFrame, group: str, features: Sequence[str],
    scopes: Mapping[str, Sequence[str]], label: str, inverse_penalty: float,
    scaling: Mapping[tuple, Mapping[str, tuple[float, float, float]]],
    iterations: int = 200, tolerance: float = 1e-11,
) -> dict[tuple, np.ndarray]:
    """{(group, fold, scope): intercept and weights on standardised features}.

    ``train`` has each row once, with the ``folds`` that train on it. Minimises the summed log loss plus
    |w|^2 / (2 C) with a free intercept by Newton steps. All groups, folds and scopes share each step: one pass over
    the rows, in which a task reduces its batches to a loss, a gradient and a curvature matrix per fit; they
    are added up and solved on the executors, and a loss, a slope and a step of each fit come back. A step that
    raises the loss is halved. ``scaling`` gives (median, mean, deviation) per (group, fold) and feature.
    """
    names = list(features)
    picks = {scope: [names.index(c) for c in chosen] for scope, chosen in scopes.items()}
    by_group: dict = {}
    for g, fold in scaling:
        by_group.setdefault(g, []).append(fold)
    rows = train.where(F.col(label).isNotNull()).select(
        group, "folds", F.col(label).cast("double").alias("_y"), *(F.col(c).cast("double") for c in names)
    )
    kind = dict(train.dtypes)[group]
    keys = [group, "fold", "scope"]

    def one_pass(weights: dict[tuple, np.ndarray]) -> dict[tuple, tuple[float, np.ndarray, np.ndarray]]:
        def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            totals: dict = {}
            for batch in batches:
                for g, part in batch.groupby(group):
                    raw, y_all = part[names].to_numpy(dtype=float), part["_y"].to_numpy()
                    sizes = part["folds"].map(len).to_numpy()
                    member, of = np.repeat(np.arange(len(part)), sizes), np.concatenate(part["folds"].to_list())
                    for fold in by_group.get(g, ()):
                        if not any((g, fold, scope) in weights for scope in picks):
                            continue
                        own = member[of == fold]
                        if not len(own):
                            continue
                        median, mean, deviation = np.array([scaling[g, fold][n] for n in names]).T
                        values = np.where(np.isnan(raw[own]), median, raw[own])
                        values = (values - mean) / np.where(deviation > 0, deviation, 1.0)
                        y = y_all[own]
                        for scope, picked in picks.items():
                            if (g, fold, scope) not in weights:
                                continue
                            x = np.column_stack([np.ones(len(y)), values[:, picked]])
                            score = x @ weights[g, fold, scope]
                            chance = 1.0 / (1.0 + np.exp(-score))
                            loss = np.logaddexp(0.0, score) - y * score
                            curve = (x * (chance * (1.0 - chance))[:, None]).T @ x
                            flat = np.concatenate([[loss.sum()], x.T @ (chance - y), curve.ravel()])
                            held = totals.get((g, fold, scope))
                            totals[g, fold, scope] = flat if held is None else held + flat
            if totals:
                out = [(*key, flat.tobytes()) for key, flat in totals.items()]
                yield pd.DataFrame(out, columns=[*keys, "m"])

        def newton(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for *key, m in batch[[*keys, "m"]].itertuples(index=False):
                    flat, at = np.frombuffer(m), weights[tuple(key)]
                    width = len(at)
                    penalty = np.full(width, 1.0 / inverse_penalty)
                    penalty[0] = 0.0
                    slope = flat[1 : 1 + width] + penalty * at
                    curve = flat[1 + width :].reshape(width, width) + np.diag(penalty)
                    step = np.linalg.lstsq(curve, slope, rcond=None)[0]
                    loss = flat[0] + 0.5 * float(penalty @ at**2)
                    done = np.max(np.abs(slope)) <= tolerance * max(1.0, flat[0])
                    out.append((*key, loss, bool(done), step.tolist()))
                yield pd.DataFrame(out, columns=[*keys, "loss", "done", "step"])

        head = f"{group} {kind}, fold int, scope string"
        sums = matrix_sums(rows.mapInPandas(reduce, f"{head}, m binary"), keys)
        steps = sums.mapInPandas(newton, f"{head}, loss double, done boolean, step array<double>")
        # a few hundred bytes for each fit, whatever the rows
        return {tuple(r[k] for k in keys): (r["loss"], r["done"], np.array(r["step"])) for r in steps.collect()}

    active = {
        (*key, scope): np.zeros(len(picked) + 1) for key in scaling for scope, picked in picks.items()
    }
    best: dict[tuple, tuple[float, np.ndarray]] = {}
    for _ in range(iterations):
        found = one_pass(active)
        following = {}
        for key, trial in active.items():
            if key not in found:
                continue
            loss, done, step = found[key]
            if key in best and loss > best[key][0] + 1e-12 * abs(loss):
                following[key] = (best[key][1] + trial) / 2
                continue
            best[key] = (loss, trial)
            if not done:
                following[key] = trial - step
        active = following
        if not active:
            break
    return {key: weights for key, (_, weights) in best.items()}


def raw_scale_fit(
    weights: np.ndarray, chosen: Sequence[str], features: Sequence[str],
    table: Mapping[str, tuple[float, float, float]],
) -> LinearFit:
    """Weights on standardised features as a fit on raw, median-imputed features."""
    raw = dict.fromkeys(features, 0.0)
    intercept = float(weights[0])
    for name, weight in zip(chosen, weights[1:]):
        _, mean, deviation = table[name]
        slope = float(weight) / (deviation if deviation > 0 else 1.0)
        raw[name] = slope
        intercept -= slope * mean
    medians = tuple(table[n][0] for n in features)
    return LinearFit(medians, intercept, tuple(raw[n] for n in features), 0.0, 0)
