"""Token ids as binary files: frequency-ranked ids in byte-aligned variable-length coding.

Texts are encoded once and written to the shared folder. The corpus-wide frequency of each id (one row
per id of the vocabulary) gives its rank, so frequent ids are small numbers. Documents are sorted by id,
and each range becomes files of this format, little endian:

    magic "TGV1" | documents: u32 | ids: u64 | doc_id: i64 each | doc_id is set: u8 each
    | length: u32 each | control bytes, four ids each, two bits an id: bytes less one | data bytes

``ranks.bin`` beside them holds the id of every rank as u32. Reading decodes control bytes by a table of
256 rows, without a loop over ids. Files go through ``pyarrow.fs`` to the folder that all executors share;
a retried task writes the same names with the same bytes.

Nulls: a null text is empty and has the end id alone; null ids come last. Rows of one id are ordered by
their text's hash; equal rows are interchangeable. An empty table gives no files and no rows. A file
ends at the first document with which it reaches ``file_ids`` ids, so its size is bounded by that and one
text.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegrid.llm.common import kept, lean
from tidegrid.llm.tokens import encoder
from tidegrid.session import scratch_path

#: Fixed value.
MAGIC = b"TGV1"
FILE_IDS = 4_000_000
#: Ids of so many documents are counted in one call.
COUNTED_IDS = 1_000_000
#: Bytes of the four ids of each control byte.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


def pack_numbers(numbers: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit numbers."""
    count = len(numbers)
    lengths = 1 + (numbers >= 1 << 8).astype(np.uint8) + (numbers >= 1 << 16) + (numbers >= 1 << 24)
    codes = np.zeros(-(-count // 4) * 4, np.uint8)
    codes[:count] = lengths - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    each = np.ascontiguousarray(numbers, "<u4").view(np.uint8).reshape(-1, 4)
    return control.tobytes(), each[np.arange(4) < lengths[:, None]].tobytes()


def unpack_numbers(control: np.ndarray, data: np.ndarray, count: int) -> np.ndarray:
    """The numbers again, by looking up each control byte's lengths."""
    lengths = LENGTHS[control].reshape(-1)[:count]
    starts = np.cumsum(lengths, dtype=np.int64) - lengths
    numbers = data[starts].astype(np.uint32)
    for more in (1, 2, 3):
        longer = np.flatnonzero(lengths > more)
        if not len(longer):
            break
        numbers[longer] |= data[starts[longer] + more].astype(np.uint32) << np.uint32(8 * more)
    return numbers


def write_file(doc_ids: list[int | None], documents: list[np.ndarray]) -> bytes:
    """One file's bytes from the ranked ids of its documents."""
    numbers = np.concatenate(documents) if documents else np.zeros(0, np.uint32)
    control, data = pack_numbers(numbers)
    return b"".join(
        (
            MAGIC,
            struct.pack("<IQ", len(documents), len(numbers)),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            np.array([d is not None for d in doc_ids], np.uint8).tobytes(),
            np.array([len(d) for d in documents], "<u4").tobytes(),
            control,
            data,
        )
    )


def read_file(content: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(document ids, lengths, ranked ids) of one file."""
    if content[:4] != MAGIC:
        raise ValueError("not a file of this format")
    documents, count = struct.unpack_from("<IQ", content, 4)
    at = 16
    ids = np.frombuffer(content, "<i8", documents, at)
    known = np.frombuffer(content, np.uint8, documents, at + 8 * documents)
    lengths = np.frombuffer(content, "<u4", documents, at + 9 * documents)
    at += 13 * documents
    controls = -(-count // 4)
    control = np.frombuffer(content, np.uint8, controls, at)
    data = np.frombuffer(content, np.uint8, len(content) - at - controls, at + controls)
    return [int(i) if k else None for i, k in zip(ids, known)], lengths, unpack_numbers(control, data, count)


def encoded(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(doc_id, tie, length, ids): every text's ids with the end id, as bytes, written once.

    ``ids`` are unsigned 16-bit numbers, or 32-bit ones for a vocabulary beyond 65,536.
    """

    def run(batches):
        for batch in lean(batches, "tokens"):
            texts = batch.column("text").to_pylist()
            end = np.array([end_id], np.uint32)
            ids = [np.concatenate((each, end), dtype=np.uint32) for each in encoder(tokenizer).encode(texts)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("tie"),
                    pa.array([len(each) for each in ids], pa.int64()),
                    pa.array([_narrow(each) for each in ids], pa.binary()),
                ],
                names=["doc_id", "tie", "length", "ids"],
            )

    source = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("tie"), F.col("text").cast("string"))
    return kept(source.mapInArrow(run, "doc_id long, tie long, length long, ids binary"), "encoded")


def _narrow(ids: np.ndarray) -> bytes:
    """A leading byte with the width, then the ids."""
    wide = len(ids) and ids.max() > 0xFFFF
    return (b"\4" + ids.astype("<u4").tobytes()) if wide else (b"\2" + ids.astype("<u2").tobytes())


def _widened(content: bytes) -> np.ndarray:
    return np.frombuffer(content, "<u4" if content[0] == 4 else "<u2", offset=1)


def id_counts(documents: Iterable[np.ndarray], at_once: int = COUNTED_IDS) -> np.ndarray:
    """How often each id occurs, counted in one array for many documents."""
    counts, held, size = np.zeros(0, np.int64), [], 0
    for ids in chain(documents, [None]):
        if ids is not None:
            held.append(ids)
            size += len(ids)
        if held and (ids is None or size >= at_once):
            more = np.bincount(np.concatenate(held))
            if len(more) > len(counts):
                counts, more = more, counts
            counts[: len(more)] += more
            held, size = [], 0
    return counts


def ranked_ids(ids: DataFrame) -> np.ndarray:
    """The ids of the corpus, most frequent first, equal counts by id.

    Comes to the driver with one row per id that occurs: bounded by the vocabulary, not by the corpus.
    """

    def count(batches):
        counts = id_counts(_widened(content.as_py()) for batch in batches for content in batch.column("ids"))
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(counts[seen], pa.int64())], names=["id", "n"])

    partial = ids.select("ids").mapInArrow(count, "id long, n long")
    rows = partial.groupBy("id").agg(F.sum("n").alias("n")).collect()
    return np.array([r["id"] for r in sorted(rows, key=lambda r: (-r["n"], r["id"]))], np.uint32)


def _target(folder: str):
    """File system and path of a shared folder; a path without a scheme is a mounted folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def write_files(ids: DataFrame, ranks: np.ndarray, folder: str, file_ids: int = FILE_IDS) -> DataFrame:
    """Write the files in ascending doc_id order and return (file, documents, ids), one row per file."""
    rank_of = np.zeros(int(ranks.max()) + 1 if len(ranks) else 1, np.uint32)
    rank_of[ranks] = np.arange(len(ranks), dtype=np.uint32)
    system, root = _target(folder)
    system.create_dir(root, recursive=True)
    with system.open_output_stream(f"{root}/ranks.bin") as out:
        out.write(ranks.astype("<u4").tobytes())
    total = ids.agg(F.sum("length")).first()[0] or 0
    ranges = max(int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // file_ids))

    def write(batches):
        place = TaskContext.get().partitionId()
        system, root = _target(folder)
        number, owners, documents, size = 0, [], [], 0

        def flush():
            name = f"part-{place:08d}-{number:06d}.tgv"
            with system.open_output_stream(f"{root}/{name}.tmp-{TaskContext.get().taskAttemptId()}") as out:
                out.write(write_file(owners, documents))
            system.move(f"{root}/{name}.tmp-{TaskContext.get().taskAttemptId()}", f"{root}/{name}")
            return pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([len(documents)], pa.int64()), pa.array([size], pa.int64())], names=["file", "documents", "ids"]
            )

        for batch in batches:
            for doc_id, content in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                each = rank_of[_widened(content.as_py())]
                owners.append(doc_id)
                documents.append(each)
                size += len(each)
                if size >= file_ids:
                    yield flush()
                    number, owners, documents, size = number + 1, [], [], 0
        if documents:
            yield flush()

    key = F.col("doc_id").asc_nulls_last()
    ordered = ids.repartitionByRange(ranges, key, F.col("tie")).sortWithinPartitions(key, "tie")
    return kept(ordered.select("doc_id", "ids").mapInArrow(write, "file string, documents long, ids long"), "files")


def read_files(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(file, doc_id, inside, n_tokens, ids) of every document and (file, offset) of every file.

    ``ids`` are unsigned 32-bit little-endian bytes, ``inside`` counts the ids before the document in its
    file and ``offset`` those of all files before, from the files' heads. ``with_starts`` adds them up.
    """
    ranks_path = f"{folder}/ranks.bin"

    def decode(batches):
        system, path = _target(ranks_path)
        with system.open_input_stream(path) as stored:
            ranks = np.frombuffer(stored.read(), "<u4")
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                doc_ids, lengths, numbers = read_file(content.as_py())
                ids = ranks[numbers].astype("<u4").tobytes()
                ends = np.cumsum(lengths, dtype=np.int64)
                starts = ends - lengths
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name.rsplit("/", 1)[-1]] * len(doc_ids), pa.string()),
                        pa.array(doc_ids, pa.int64()),
                        pa.array(starts, pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array([ids[4 * s : 4 * e] for s, e in zip(starts, ends)], pa.binary()),
                    ],
                    names=["file", "doc_id", "inside", "n_tokens", "ids"],
                )

    def sizes(batches):
        for batch in batches:
            names = [path.rsplit("/", 1)[-1] for path in batch.column("path").to_pylist()]
            system, root = _target(folder)
            heads = []
            for name in names:
                with system.open_input_file(f"{root}/{name}") as stored:
                    heads.append(struct.unpack_from("<IQ", stored.read(16), 4)[1])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(heads, pa.int64())], names=["file", "count"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tgv").load(folder).select("path", "content")
    counts = files.select("path").mapInArrow(sizes, "file string, count long")
    before = F.sum("count").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select("file", F.coalesce(before, F.lit(0)).alias("offset"))
    documents = files.mapInArrow(decode, "file string, doc_id long, inside long, n_tokens long, ids binary")
    return documents, offsets


def with_starts(documents: DataFrame, offsets: DataFrame) -> DataFrame:
    """Documents with ``start``, the ids of all documents before; call it after ``ids`` are digested."""
    joined = documents.join(offsets, "file")
    return joined.withColumn("start", F.col("offset") + F.col("inside")).drop("offset", "inside", "file")


def round_trip(
    docs: DataFrame, tokenizer: str, end_id: int = 1, file_ids: int = FILE_IDS, folder: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Encode, rank and write the files, then open them again by ``read_files``."""
    folder = folder or scratch_path(docs.sparkSession, "token-files")
    ids = encoded(docs, tokenizer, end_id)
    write_files(ids, ranked_ids(ids), folder, file_ids)
    return read_files(docs.sparkSession, folder)
