"""Toxicity by multiple-instance learning with a noisy-or.

A document is a bag of sentences. A sentence's score is a logistic unit over its hashed words and their
beginnings (4 to 6 bytes, for inflected and compound words), and a document is toxic unless every sentence is harmless: 1 - product of (1 - sentence score). Word weights are learned from
document labels on a sample of at most ``sample_rows`` labelled documents (a parameter; rows of the
held-out fold never), so the sentences that make a document toxic are found without sentence labels.

A null or empty text has no sentence and scores 0. Without labelled rows of both kinds every score is the
labels' share (0 without rows). Repeated rows score alike; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.labels import labelled_sample

BUCKETS = 1 << 20
BEGINNINGS = (4, 5, 6)
SAMPLE_ROWS = 6000
THRESHOLD = 0.5
CHUNK_CHARS = 500_000
SENTENCE = re.compile(r"[^.!?\n]+")

_LETTER = np.zeros(256, bool)
_LETTER[48:58] = _LETTER[97:123] = _LETTER[128:] = True
_END = np.zeros(256, bool)
_END[list(b".!?\n")] = True
_POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))


def bags(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each word or beginning, its sentence, document of each sentence that has words)."""
    contents = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    raw = np.frombuffer(b"\n".join(contents) + b"\n", np.uint8)
    first = np.cumsum([0, *(len(c) + 1 for c in contents[:-1])])
    letter = _LETTER[raw]
    starts = np.flatnonzero(letter & ~np.concatenate([[False], letter[:-1]]))
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    body = raw[letter]
    at = np.cumsum(letter)[starts] - 1
    place = np.arange(len(body)) - np.repeat(at, np.diff(np.append(at, len(body))))
    spelled = body.astype(np.uint64) * _POWERS[place & 63]
    length = np.diff(np.append(at, len(body)))
    _, begin, sentence = np.unique(np.cumsum(_END[raw])[starts], return_index=True, return_inverse=True)
    hashes, sentences = [np.add.reduceat(spelled, at)], [sentence]
    for size in BEGINNINGS:
        longer = np.flatnonzero(length > size)
        part = spelled[at[longer][:, None] + np.arange(size)].sum(axis=1, dtype=np.uint64)
        hashes.append(part + np.uint64(size * 0xD6E8FEB86659FD93 % (1 << 64)))
        sentences.append(sentence[longer])
    hashed = np.concatenate(hashes)
    hashed ^= hashed >> np.uint64(29)
    bucket = ((hashed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(44)).astype(np.int64)
    return bucket, np.concatenate(sentences), np.searchsorted(first, starts[begin], "right") - 1


def _harm(z):
    """-log of a sentence's harmlessness."""
    return np.logaddexp(0, z)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    share: float | None = None

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.share is not None:
            return np.full(len(texts), self.share)
        out, start, chars = [], 0, 0
        for at, text in enumerate(texts):
            chars += len(text or "")
            if chars > CHUNK_CHARS or at == len(texts) - 1:
                bucket, sentence, doc = bags(texts[start : at + 1])
                z = self.bias + np.bincount(sentence, self.weights[bucket], minlength=len(doc))
                out.append(1 - np.exp(-np.bincount(doc, _harm(z), minlength=at + 1 - start)))
                start, chars = at + 1, 0
        return np.concatenate(out) if out else np.zeros(0)


def telling_words(found: list[np.ndarray], y: np.ndarray, deviations: float = 3.0, odds: float = 3.0) -> np.ndarray:
    """Buckets whose documents are surely toxic more often than others.

    The lower Wilson bound of a word's share of toxic documents must have ``odds`` times the odds of all
    documents: names and accidents of a few texts are not learned.
    """
    seen, bad = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for pairs, label in zip(found, y):
        own = np.unique(pairs[:, 0])
        seen[own] += 1
        bad[own] += label
    n, share, z = np.maximum(seen, 1), bad / np.maximum(seen, 1), deviations**2
    low = (share + z / (2 * n) - deviations * np.sqrt(share * (1 - share) / n + z / (4 * n * n))) / (1 + z / n)
    base = y.mean()
    return np.flatnonzero((seen > 0) & (low / np.maximum(1 - low, 1e-9) > odds * base / (1 - base)))


def fit(found: list[np.ndarray], y: np.ndarray, steps: int = 300, rate: float = 0.5, decay: float = 1e-5) -> Model:
    """AdaGrad on the likelihood of document labels under the noisy-or, over the telling words, all bags at once.

    ``found`` has per document the distinct (bucket, sentence) pairs, sentences numbered from 0.
    """
    if len(y) == 0 or y.min() == y.max():
        return Model(np.zeros(0), 0.0, float(y.mean()) if len(y) else 0.0)
    chosen = telling_words(found, y)
    number = np.full(BUCKETS, -1)
    number[chosen] = np.arange(len(chosen))
    counts = np.array([f[:, 1].max() + 1 if len(f) else 0 for f in found], np.int64)
    sentences, offset = int(counts.sum()), np.cumsum(counts) - counts
    doc = np.repeat(np.arange(len(y)), counts)
    used = [f[number[f[:, 0]] >= 0] for f in found]
    word = np.concatenate([number[f[:, 0]] for f in used])
    sentence = np.concatenate([f[:, 1] + o for f, o in zip(used, offset)])
    weights, bias = np.zeros(len(chosen)), float(np.log(y.mean() * len(y) / max(1, sentences)))
    seen, seen_bias = np.full(len(chosen), 1e-12), 1e-12
    for _ in range(steps):
        z = bias + np.bincount(sentence, weights[word], minlength=sentences)
        total = np.bincount(doc, _harm(z), minlength=len(y))
        slope = np.where(y > 0, -np.exp(-total) / np.maximum(-np.expm1(-total), 1e-9), 1.0)
        dz = slope[doc] / (1 + np.exp(-np.clip(z, -60, 60)))
        grad = np.bincount(word, dz[sentence], minlength=len(chosen)) / len(y) + decay * weights
        grad_bias = dz.sum() / len(y)
        seen, seen_bias = seen + grad**2, seen_bias + grad_bias**2
        weights -= rate * grad / np.sqrt(seen)
        bias -= rate * grad_bias / np.sqrt(seen_bias)
    full = np.zeros(BUCKETS)
    full[chosen] = weights
    return Model(full, bias)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Sentences of the sample are hashed on the executors; the driver fits on at most ``sample_rows`` bags."""

    def measure(batches):
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                bucket, sentence, _ = bags([text])
                key = np.unique(sentence * BUCKETS + bucket)
                content = np.column_stack([key % BUCKETS, key // BUCKETS]).astype("<i4").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([label], pa.int32()), pa.array([content], pa.binary())], names=["label", "bag"])

    sample = labelled_sample(docs, labels, label, sample_rows).mapInArrow(measure, "label int, bag binary")
    rows = sorted((bytes(r["bag"]), r["label"]) for r in sample.collect())
    return fit([np.frombuffer(bag, "<i4").reshape(-1, 2) for bag, _ in rows], np.array([y for _, y in rows], np.float64))


def score(model: Model, text: str = "text") -> Column:
    """The score of each text as a column; other columns of the frame stay in the JVM."""

    @F.pandas_udf("double")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for each in series:
            yield pd.Series(model.scores([t if isinstance(t, str) else None for t in each]))

    return run(F.col(text).cast("string"))


def offending(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, start, end, score): sentences that reach the threshold, in code points, end exclusive."""

    def run(batches):
        for batch in batches:
            out = {"doc_id": [], "start": [], "end": [], "score": []}
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                spans = [m.span() for m in SENTENCE.finditer(text or "")]
                for (start, end), value in zip(spans, model.scores([text[s:e] for s, e in spans])):
                    if value >= threshold:
                        for name, x in zip(out, (doc_id, start, end, float(value))):
                            out[name].append(x)
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], names=list(out))

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return source.mapInArrow(run, "doc_id long, start int, end int, score double")
