"""Best-fit packing of documents into sequences, with capacities in several dimensions.

Texts are encoded and cut into pieces of at most the sequence's tokens. A piece has three demands:
tokens, documents (one) and attention cost (its length squared), each with a capacity. Pieces are taken
in descending length; among the open sequences with room in every dimension, the one is chosen whose
residual capacities have the least weighted norm after placing (or the largest weighted dot product of
the demands with its used shares). A sequence closes when its residual is below the shortest piece.

Pieces are dealt evenly to blocks of ``block_pieces``; each block is packed on its own by one task, and
its last sequences are the only waste, so blocks bound memory and time at any size. A document is
longer than a sequence only if cut; a full piece fills a sequence alone.

Nulls: a null text is empty and has only the end id; a null id is kept. Repeated rows are packed as
rows of their own. An empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import kept, lean
from tidegrid.llm.tokens import encoder

CAPACITY = 2048
BLOCK_PIECES = 16_384
WEIGHTS = (1.0, 0.05, 0.25)


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids) of every text; ids as unsigned 32-bit little-endian bytes."""

    def run(batches):
        for batch in lean(batches, "tokens"):
            doc_ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            out = {name: [] for name in ("doc_id", "piece", "start", "length", "ids")}
            for doc_id, ids in zip(doc_ids, encoder(tokenizer).encode(texts)):
                ids = np.append(ids, end_id).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    cut = ids[start : start + capacity]
                    for name, value in zip(out, (doc_id, piece, start, len(cut), cut.tobytes())):
                        out[name].append(value)
                if len(out["ids"]) >= 2000:
                    yield _batch(out)
                    out = {name: [] for name in out}
            if out["ids"]:
                yield _batch(out)
            del doc_ids, texts, out
            pa.default_memory_pool().release_unused()

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return source.mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def _batch(out):
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], names=list(out))


def best_fit(
    lengths: np.ndarray,
    capacity: int = CAPACITY,
    most_pieces: int | None = None,
    most_attention: int | None = None,
    weights: Sequence[float] = WEIGHTS,
    rule: str = "norm",
) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece of one block.

    The capacities default to what the tokens allow (as many pieces, the square of the tokens). A piece
    that exceeds a capacity alone raises ValueError.
    """
    lengths = np.asarray(lengths, np.int64)
    limits = np.array([capacity, most_pieces or capacity, most_attention or capacity * capacity], np.float64)
    demands = np.stack([lengths, np.ones_like(lengths), lengths * lengths], axis=1) / limits
    if len(lengths) and demands.max() > 1:
        raise ValueError("a piece exceeds a capacity by itself")
    weight = np.asarray(weights, np.float64)
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    residual = np.zeros((1024, 3))  # of the open sequences, in the first ``count`` rows
    number = np.zeros(1024, np.int64)
    filled: list[int] = []
    count, slack = 0, 1e-12
    order = np.argsort(-lengths, kind="stable")
    least = demands[order[-1]] - slack if len(order) else None
    for at in order:
        demand = demands[at]
        left = residual[:count] - demand
        fits = np.flatnonzero((left >= -slack).all(axis=1))
        if len(fits):
            room = left[fits]
            if rule == "norm":
                place = fits[np.argmin((room * room) @ weight)]
            else:
                place = fits[np.argmax((1 - room - demand) @ (weight * demand))]
        else:
            if count == len(residual):
                residual, number = np.concatenate([residual, residual * 0]), np.concatenate([number, number * 0])
            place, count = count, count + 1
            residual[place], number[place] = 1.0, len(filled)
            filled.append(0)
        own = number[place]
        sequence[at], offset[at] = own, filled[own]
        filled[own] += int(lengths[at])
        residual[place] -= demand
        if (residual[place] < least).any():  # closed: the last open sequence takes its row
            count -= 1
            residual[place], number[place] = residual[count], number[count]
    return sequence, offset


def packed(
    cut: DataFrame,
    capacity: int = CAPACITY,
    most_pieces: int | None = None,
    most_attention: int | None = None,
    weights: Sequence[float] = WEIGHTS,
    rule: str = "norm",
    block_pieces: int = BLOCK_PIECES,
) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``; other columns of ``cut`` stay.

    ``cut`` must be a stored table: a piece's block follows from its place in it.
    """
    total = cut.count()
    blocks = max(1, -(-total // block_pieces))
    columns = cut.columns

    def run(block: pd.DataFrame) -> pd.DataFrame:
        sequence, offset = best_fit(block["length"].to_numpy(), capacity, most_pieces, most_attention, weights, rule)
        out = block[columns].copy()
        out["sequence_id"] = (int(block["_block"].iloc[0]) << 32) + sequence
        out["offset"] = offset
        return out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)
    dealt = cut.withColumn("_block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)))
    return dealt.groupBy("_block").applyInPandas(run, f"{schema}, sequence_id long, offset long")


def digested(cut: DataFrame) -> DataFrame:
    """Pieces with the CRC-32 of their ids in place of the ids, written once."""
    return kept(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces")
