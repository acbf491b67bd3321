"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE_WORDS`` words. Each passage's measurements (shares of letter
and sign classes, word length, repeated words and so on) go through a learned encoder; gated attention
weighs the passages of a bag, and a logistic unit scores the weighted representation. Encoder, attention
and unit are trained together from document labels, on a sample of at most ``sample_rows`` labelled
documents (a parameter; rows of the held-out fold never). Every text is scored whole, in Arrow batches.

A null or empty text is one empty passage. With no labelled rows, or rows of one label only, every score is
that label's share (0.5 without rows). Repeated rows score alike; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import lean
from tidegrid.llm.labels import labelled_sample

PASSAGE_WORDS = 100
SAMPLE_ROWS = 4000
THRESHOLD = 0.3
CHUNK_CHARS = 500_000

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SIGNS = b".,!?;:'\"-_()[]{}<>/\\|#$%&*@=+~^`"


def _classes() -> np.ndarray:
    """Byte to class: lower case, upper case, digit, beyond ASCII, each sign, control."""
    kind = np.full(256, 4 + len(_SIGNS), np.int64)
    kind[97:123], kind[65:91], kind[48:58], kind[128:] = 0, 1, 2, 3
    for n, sign in enumerate(_SIGNS):
        kind[sign] = 4 + n
    return kind


_CLASS = _classes()
CLASSES = 5 + len(_SIGNS)
FEATURES = CLASSES + 6
_POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))


def passages(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(measurements of all passages, number of passages of each text), without a loop over words."""
    contents = [(t or "").encode("utf-8", "replace") for t in texts]
    raw = np.frombuffer(b"\n".join(contents) + b"\n", np.uint8)
    first_byte = np.cumsum([0, *(len(c) + 1 for c in contents[:-1])])
    space = _SPACE[raw]
    before = np.concatenate([[True], space[:-1]])
    starts = np.flatnonzero(~space & before)
    words = len(starts)
    doc = np.searchsorted(first_byte, starts, "right") - 1
    per_doc = np.bincount(doc, minlength=len(texts))
    bags = np.maximum(1, -(-per_doc // PASSAGE_WORDS))
    base = np.cumsum(bags) - bags
    total = int(bags.sum())
    if not words:
        return np.zeros((total, FEATURES)), bags
    passage = base[doc] + (np.arange(words) - (np.cumsum(per_doc) - per_doc)[doc]) // PASSAGE_WORDS
    body = raw[~space]
    at = np.cumsum(~space)[starts] - 1  # where each word starts in the body
    length = np.diff(np.append(at, len(body)))
    kind = _CLASS[body]
    shares = np.bincount(np.repeat(passage, length) * CLASSES + kind, minlength=total * CLASSES).reshape(total, CLASSES)
    place = np.arange(len(body)) - np.repeat(at, length)
    hashed = np.add.reduceat(body.astype(np.uint64) * _POWERS[place & 63], at)
    again = np.concatenate([[False], (hashed[1:] == hashed[:-1]) & (passage[1:] == passage[:-1])])
    last = at + length - 1
    sign_end = kind[last] >= 4
    double_end = sign_end & (length > 1) & (kind[np.maximum(last - 1, 0)] >= 4)
    letters = np.add.reduceat(kind < 4, at)
    count = np.bincount(passage, minlength=total)
    mean = lambda values: np.bincount(passage, values, minlength=total) / np.maximum(count, 1)
    size = shares.sum(axis=1)
    rest = [mean(length) / 10, mean(again), mean(double_end), mean(letters == 0), mean(sign_end), np.log1p(count) / 5]
    return np.column_stack([shares / np.maximum(size, 1)[:, None], *rest]), bags


@dataclass
class Model:
    """Encoder, gate and unit; ``share`` is the score when there was nothing to learn."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]
    share: float | None = None

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.share is not None:
            return np.full(len(texts), self.share)
        out, start, chars = [], 0, 0
        for at, text in enumerate(texts):
            chars += len(text or "")
            if chars > CHUNK_CHARS or at == len(texts) - 1:
                x, bags = passages(texts[start : at + 1])
                out.append(_sigmoid(_forward((x - self.mean) / self.scale, bags, self.weights)["logit"]))
                start, chars = at + 1, 0
        return np.concatenate(out) if out else np.zeros(0)

    def attention(self, text: str | None) -> np.ndarray:
        """The weight of each passage of one text."""
        x, bags = passages([text])
        return _forward((x - self.mean) / self.scale, bags, self.weights)["alpha"]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _forward(x, bags, w):
    first = np.cumsum(bags) - bags
    h = np.tanh(x @ w["W"] + w["b"])
    a, g = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
    energy = (a * g) @ w["w"]
    alpha = np.exp(energy - np.repeat(np.maximum.reduceat(energy, first), bags))
    alpha /= np.repeat(np.add.reduceat(alpha, first), bags)
    z = np.add.reduceat(alpha[:, None] * h, first, axis=0)
    return {"h": h, "a": a, "g": g, "alpha": alpha, "z": z, "first": first, "logit": z @ w["c"] + w["d"][0]}


def fit(x: np.ndarray, bags: np.ndarray, y: np.ndarray, steps: int = 300, width: int = 16, gate: int = 8, seed: int = 3) -> Model:
    """Adam on the cross-entropy of document labels, all bags at once; a small weight decay."""
    if len(y) == 0 or y.min() == y.max():
        return Model(np.zeros(FEATURES), np.ones(FEATURES), {}, float(y.mean()) if len(y) else 0.5)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    x = np.clip((x - mean) / scale, -1e3, 1e3)
    rng = np.random.default_rng(seed)
    shapes = {"W": (x.shape[1], width), "b": (width,), "V": (width, gate), "U": (width, gate), "w": (gate,), "c": (width,), "d": (1,)}
    w = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) for k, s in shapes.items()}
    m, v = {k: np.zeros(s) for k, s in shapes.items()}, {k: np.zeros(s) for k, s in shapes.items()}
    for step in range(1, steps + 1):
        f = _forward(x, bags, w)
        ds = (_sigmoid(f["logit"]) - y) / len(y)
        dz = np.repeat(ds, bags)[:, None] * w["c"]
        dalpha = (f["h"] * dz).sum(axis=1)
        inner = np.add.reduceat(f["alpha"] * dalpha, f["first"])
        de = f["alpha"] * (dalpha - np.repeat(inner, bags))
        da, dg = de[:, None] * w["w"] * f["g"] * (1 - f["a"] ** 2), de[:, None] * w["w"] * f["a"] * f["g"] * (1 - f["g"])
        dh = (f["alpha"][:, None] * dz + da @ w["V"].T + dg @ w["U"].T) * (1 - f["h"] ** 2)
        grads = {
            "W": x.T @ dh, "b": dh.sum(axis=0), "V": f["h"].T @ da, "U": f["h"].T @ dg,
            "w": (f["a"] * f["g"]).T @ de, "c": f["z"].T @ ds, "d": np.array([ds.sum()]),
        }
        for k in w:
            grad = grads[k] + 1e-4 * w[k]
            m[k] = 0.9 * m[k] + 0.1 * grad
            v[k] = 0.999 * v[k] + 0.001 * grad**2
            w[k] = w[k] - 0.03 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, w)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Passages of the sample are measured on the executors; the driver fits on at most ``sample_rows`` bags."""

    def measure(batches):
        for batch in lean(batches):
            texts = batch.column("text").to_pylist()
            for at in range(0, len(texts), 200):
                x, bags = passages(texts[at : at + 200])
                parts = np.split(x.astype("<f4"), np.cumsum(bags)[:-1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("label").slice(at, len(bags)), pa.array([p.tobytes() for p in parts], pa.binary())], names=["label", "bag"]
                )

    sample = labelled_sample(docs, labels, label, sample_rows).mapInArrow(measure, "label int, bag binary")
    rows = sorted((bytes(r["bag"]), r["label"]) for r in sample.collect())
    bags = [np.frombuffer(bag, "<f4").reshape(-1, FEATURES) for bag, _ in rows]
    x = np.concatenate(bags).astype(np.float64) if bags else np.zeros((0, FEATURES))
    return fit(x, np.array([len(b) for b in bags], np.int64), np.array([y for _, y in rows], np.float64))


def score(model: Model, text: str = "text") -> Column:
    """The score of each text as a column; other columns of the frame stay in the JVM."""

    @F.pandas_udf("double")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for each in lean(series):
            yield pd.Series(model.scores([t if isinstance(t, str) else None for t in each]))

    return run(F.col(text).cast("string"))
