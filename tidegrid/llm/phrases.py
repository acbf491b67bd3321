"""Phrases whose words occur together more often than chance, counted in HAT-tries.

Texts are lower-cased (A-Z), split at punctuation and line ends into pieces, pieces at spaces and tabs into words.
Phrases of 2 to ``longest`` words with at least ``least`` occurrences in their language are candidates. A task counts
phrases of one length in a HAT-trie: a shallow trie over word ids whose leaves are hash containers of the remaining
ids; a container that grows too large bursts into a node with a container for each next word. When a task
holds too many entries, whole subtrees, the largest first, leave as sorted runs. The runs of a first word meet in one
partition and are added up there; the runs of a very frequent one are dealt to several by the second word.

No phrase is frequent unless its words, and its pairs of neighbours, are. So there are three passes over the
texts: words, pairs of frequent words, longer phrases of frequent pairs. Frequent words and pairs go to the tasks as
bitmaps of a fixed size; a shared bit lets a rare phrase be counted, it never hides a frequent one. All counts are exact.

Cutting a candidate after its first k words gives a first part (l occurrences) and a rest (r); its score is the
least floor(``scale`` * a * n / (l * r)) over its cuts, n all words of the language, in integers of 38 digits.
A candidate goes if a longer candidate holds its words in a row and has ``percent`` percent of its occurrences;
that needs a look at candidates of one word more only, as counts never grow with length.

A null text is empty, a null language is ``und``, ties are broken by phrase. An id, a repeated row or an extra column does
not matter: every row's text counts. An empty table gives an empty one.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegrid.llm.common import kept, lean, text_of

#: What ends a piece, what separates words, capital letters and their small ones.
ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
CAPITALS, SMALL = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
_PLAIN = bytes.maketrans(CAPITALS + ENDS + BLANKS, SMALL + b"\n" * len(ENDS) + b" " * len(BLANKS))

#: The production run.
LEAST, LONGEST, TOP, PERCENT, SCALE = 100, 5, 2000, 100, 1000

#: Entries of a container before it bursts, entries of a task before subtrees leave, bytes of text counted at once,
#: refused words that a task remembers.
BURST, MOST, CHUNK, REFUSED = 16_384, 1_000_000, 8 << 20, 400_000

#: Bits of each map of frequent words and pairs (8 MB).
FILTER_BITS = 1 << 26

#: Single words meet in so many parts; a first word with more than one share of all occurrences is dealt to as many parts.
WORD_PARTS, SHARES = 4096, 1000

_ID = np.dtype(">i4")  # keys of one container sort like their ids


class HatTrie:
    """Counts of sequences of ``length`` ids (two or more)."""

    def __init__(self, length: int, burst: int = BURST):
        self.length, self.burst = length, burst
        self.root: dict[int, dict | Counter] = {}
        self.sizes: Counter[int] = Counter()
        self.entries = 0

    def add(self, rows: np.ndarray) -> None:
        """Count each row of a matrix of ids once."""
        for first, grew in self._add(self.root, rows, None):
            self.sizes[first] += grew
            self.entries += grew

    def _add(self, node: dict, rows: np.ndarray, counts: np.ndarray | None) -> Iterator[tuple[int, int]]:
        """Add the rows below a node; gives (first id, entries gained)."""
        order = np.argsort(rows[:, 0], kind="stable")
        rows = rows[order]
        edges = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]])
        rest = np.ascontiguousarray(rows[:, 1:]).astype(_ID)
        keys = rest.view(f"V{rest.shape[1] * _ID.itemsize}").ravel().tolist()
        weights = None if counts is None else counts[order]
        for first, low, high in zip(rows[edges, 0].tolist(), edges.tolist(), [*edges[1:].tolist(), len(rows)]):
            child = node.get(first)
            if isinstance(child, Counter) or child is None:
                if child is None:
                    child = node[first] = Counter()
                before = len(child)
                if weights is None:
                    child.update(keys[low:high])
                else:
                    child.update(dict(zip(keys[low:high], weights[low:high].tolist())))
                if len(child) > self.burst and rest.shape[1] > 1:
                    node[first] = self._burst(child)
                yield first, len(child) - before
            else:
                part = None if weights is None else weights[low:high]
                yield first, sum(grew for _, grew in self._add(child, rows[low:high, 1:], part))

    def _burst(self, container: Counter) -> dict:
        node: dict[int, dict | Counter] = {}
        rows, counts = self._rows(container)
        for _ in self._add(node, rows, counts):
            pass
        return node

    @staticmethod
    def _rows(container: Counter) -> tuple[np.ndarray, np.ndarray]:
        keys = b"".join(container)
        counts = np.fromiter(container.values(), np.int64, len(container))
        return np.frombuffer(keys, _ID).reshape(len(container), -1), counts

    def _gather(self, child, prefix: tuple[int, ...], into: list) -> None:
        if isinstance(child, Counter):
            rows, counts = self._rows(child)
            head = np.broadcast_to(np.array(prefix, _ID), (len(rows), len(prefix)))
            into.append((np.hstack([head, rows]), counts))
        else:
            for key, below in child.items():
                self._gather(below, (*prefix, key), into)

    def spill(self, down_to: int = 0) -> tuple[np.ndarray, np.ndarray] | None:
        """Whole subtrees, the largest first, until ``down_to`` entries are left: (rows, counts)."""
        taken: list = []
        for first, size in self.sizes.most_common():
            if self.entries <= down_to:
                break
            self._gather(self.root.pop(first), (first,), taken)
            del self.sizes[first]
            self.entries -= size
        if not taken:
            return None
        return np.vstack([rows for rows, _ in taken]), np.concatenate([counts for _, counts in taken])


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Array]]:
    """(language, texts) of at most ``CHUNK`` bytes, or one text."""
    sizes = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False))
    low = 0
    while low < batch.num_rows:
        base = int(sizes[low - 1]) if low else 0
        high = max(low + 1, int(np.searchsorted(sizes, base + CHUNK, side="right")))
        part = batch.slice(low, high - low)
        for lang in pc.unique(part.column("lang")).to_pylist():
            yield lang, part.filter(pc.equal(part.column("lang"), lang)).column("text")
        low = high


def _words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All words of the texts in order, and the number of the piece that each stands in."""
    wide = texts.cast(pa.large_binary())
    _, offsets, data = wide.buffers()
    plain = pa.py_buffer((data.to_pybytes() if data else b"").translate(_PLAIN))
    texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(wide), [None, offsets, plain], offset=wide.offset)
    pieces = pc.list_flatten(pc.split_pattern(texts, b"\n"))
    split = pc.split_pattern(pieces, b" ")
    words, piece = pc.list_flatten(split), pc.list_parent_indices(split)
    full = pc.greater(pc.binary_length(words), 0)
    return words.filter(full).dictionary_encode(), piece.filter(full).to_numpy()


class Ids:
    """Numbers of a task's words by language; words that the filter refuses have none (-1)."""

    def __init__(self, lang: str, frequent: np.ndarray | None, heavy: dict[tuple[str, str], int]):
        self.lang, self.lead, self.frequent, self.heavy = lang, lang.encode() + b"\x00", frequent, heavy
        self.ids: dict[bytes, int] = {}
        self.words: list[bytes] = []
        self.crc: list[int] = []

    def of(self, words: pa.DictionaryArray) -> np.ndarray:
        given = words.dictionary.to_pylist()
        numbers = list(map(self.ids.get, given))
        new = [i for i, number in enumerate(numbers) if number is None]
        if new:
            start = zlib.crc32(self.lead)
            crc = [zlib.crc32(given[i], start) for i in new]
            passes = [1] * len(new) if self.frequent is None else _has(self.frequent, np.array(crc, np.int64)).tolist()
            for i, code, passed in zip(new, crc, passes):
                numbers[i] = self.ids[given[i]] = len(self.words) if passed else -1
                if passed:
                    self.words.append(given[i])
                    self.crc.append(code)
        found = np.array(numbers, np.int64)[words.indices.to_numpy(zero_copy_only=False)] if given else np.zeros(0, np.int64)
        if len(self.ids) - len(self.words) > REFUSED:
            self.ids = {word: number for number, word in enumerate(self.words)}
        return found

    @property
    def parts(self) -> np.ndarray:
        """In how many parts the phrases of each first word are dealt."""
        parts = np.ones(len(self.words), np.int64)
        for (lang, word), some in self.heavy.items():
            if lang == self.lang and (number := self.ids.get(word.encode(), -1)) >= 0:
                parts[number] = some
        return parts


def _has(bits: np.ndarray, position):
    position = position & (len(bits) * 8 - 1)
    return (bits[position >> 3] >> (position & 7)) & 1


def _pair_position(first, second):
    """Where a pair of words lies in its map: from the CRC-32 of both, as a column or as numbers."""
    return first * 1_000_003 + second


def _run(known: Ids, rows: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A sorted run of phrases of one length: (lang, head, part, size, lines).

    ``head`` is the first word, one row holds its phrases in the order of their words, each a line of the further words and
    the count. The second word's hash deals the phrases of a heavy first word to several parts; single words
    are dealt to parts by their hash.
    """
    length = rows.shape[1]
    words, crc = pa.array(known.words, pa.large_binary()), np.array(known.crc, np.int64)
    rank = np.empty(len(words), np.int64)
    rank[pc.sort_indices(words).to_numpy()] = np.arange(len(words))
    rows = rows.astype(np.int64)
    if length == 1:
        head, part = np.zeros(len(rows), np.int64), crc[rows[:, 0]] % WORD_PARTS
    else:
        head, part = rows[:, 0], crc[rows[:, 1]] % known.parts[rows[:, 0]]
    order = np.lexsort((*(rank[rows[:, i]] for i in range(length - 1, 0 if length > 1 else -1, -1)), part, head))
    rows, counts, head, part = rows[order], counts[order], head[order], part[order]
    written = pa.array(counts).cast(pa.string()).cast(pa.large_binary())
    rest = [words.take(pa.array(rows[:, i])) for i in range(1 if length > 1 else 0, length)]
    lines = pc.binary_join_element_wise(*rest, written, pa.scalar(b" ", pa.large_binary()))
    turn = (head[1:] != head[:-1]) | (part[1:] != part[:-1]) | (np.arange(1, len(rows)) % BURST == 0)
    starts = np.flatnonzero(np.r_[True, turn])
    for low in range(0, len(starts), 20_000):
        at = starts[low : low + 20_000]
        ends = np.r_[at[1:], starts[low + 20_000] if low + 20_000 < len(starts) else len(rows)]
        lists = pa.ListArray.from_arrays(pa.array(np.r_[at, ends[-1]] - at[0], pa.int32()), lines.slice(at[0], ends[-1] - at[0]))
        heads = words.take(pa.array(head[at])) if length > 1 else pa.array([b""] * len(at), pa.large_binary())
        text = lambda a: a.cast(pa.large_utf8()).cast(pa.utf8())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([known.lang] * len(at), pa.utf8()), text(heads), pa.array(part[at], pa.int32()),
                pa.array([length] * len(at), pa.int32()), text(pc.binary_join(lists, pa.scalar(b"\n", pa.large_binary()))),
            ],
            ["lang", "head", "part", "size", "lines"],
        )


def _windows(ids: np.ndarray, piece: np.ndarray, length: int, pairs: np.ndarray | None) -> np.ndarray:
    """Rows of ``length`` neighbouring words of one piece, all of them numbered, all pairs frequent."""
    m = len(ids) - length + 1
    if m <= 0:
        return np.zeros((0, length), np.int64)
    fits = piece[:m] == piece[length - 1 :]
    for i in range(length):
        fits &= ids[i : m + i] >= 0
    if pairs is not None:
        for i in range(length - 1):
            fits &= pairs[i : m + i]
    return np.lib.stride_tricks.sliding_window_view(ids, length)[fits]


def runs(
    batches: Iterator[pa.RecordBatch], lengths: tuple[int, ...], words, pairs, heavy: dict, burst: int, most: int
) -> Iterator[pa.RecordBatch]:
    """The runs of one task, a phrase in as many as it needs."""
    bits = lambda shared: None if shared is None else np.frombuffer(shared.value, np.uint8)
    word_bits, pair_bits = bits(words), bits(pairs)
    numbers: dict[str, Ids] = {}
    single: dict[str, Counter[int]] = {}
    tries: dict[tuple[str, int], HatTrie] = {}

    def out(down_to: int):
        for lang, counter in single.items():
            if counter and sum(map(len, single.values())) > down_to:
                rows = np.fromiter(counter, np.int64, len(counter))[:, None]
                yield from _run(numbers[lang], rows, np.fromiter(counter.values(), np.int64, len(counter)))
                counter.clear()
                if not tries:
                    numbers[lang] = Ids(lang, word_bits, heavy)  # rare words are not kept from run to run
        share = down_to // max(len(tries), 1)
        for (lang, _), trie in tries.items():
            spilled = trie.spill(share)
            if spilled is not None:
                yield from _run(numbers[lang], *spilled)

    for batch in batches:
        for lang, texts in _chunks(batch):
            known = numbers.setdefault(lang, Ids(lang, word_bits, heavy))
            found, piece = _words(texts)
            ids = known.of(found)
            near = None
            if pair_bits is not None and len(ids):
                crc = np.append(np.array(known.crc, np.int64), 0)  # -1 takes the last
                near = _has(pair_bits, _pair_position(crc[ids[:-1]], crc[ids[1:]])).astype(bool)
            for length in lengths:
                if length == 1:
                    single.setdefault(lang, Counter()).update(ids[ids >= 0].tolist())
                    continue
                trie = tries.setdefault((lang, length), HatTrie(length, burst))
                rows = _windows(ids, piece, length, near)
                if len(rows):
                    trie.add(rows)
            if sum(t.entries for t in tries.values()) + sum(map(len, single.values())) > most:
                yield from out(most // 2)
    yield from out(0)


def counted(
    docs: DataFrame, lengths: tuple[int, ...], words=None, pairs=None, heavy: dict | None = None, burst: int = BURST, most: int = MOST
) -> DataFrame:
    """(lang, phrase, size, n) of every phrase of the given lengths whose words (and pairs) the maps let through.

    ``heavy`` names first words whose phrases are dealt to several partitions, and to how many.
    """
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_of().alias("text"))

    def count(batches):
        return runs(lean(batches, "phrases"), lengths, words, pairs, heavy or {}, burst, most)

    where = ("lang", "head", "part", "size")
    met = texts.mapInArrow(count, "lang string, head string, part int, size int, lines string").repartition("lang", "head", "part")
    lines = met.select(*where, F.explode(F.split("lines", "\n")).alias("line")).withColumn("n", F.substring_index("line", " ", -1))
    rest = F.substring("line", F.lit(1), F.length("line") - F.length("n") - 1)
    lines = lines.select(*where, rest.alias("rest"), F.col("n").cast("long").alias("n"))
    phrase = F.when(F.col("size") == 1, F.col("rest")).otherwise(F.concat_ws(" ", "head", "rest"))
    return lines.groupBy(*where, "rest").agg(F.sum("n").alias("n")).select("lang", phrase.alias("phrase"), "size", "n")


def _word_crc(word: Column) -> Column:
    return F.crc32(F.concat(F.col("lang"), F.lit("\x00"), word).cast("binary"))


def _shared_bits(frequent: DataFrame, position: Column, bits: int):
    """A broadcast bitmap of ``bits`` bits, built by Spark; its size does not depend on the input."""
    place = position.bitwiseAND(F.lit(bits - 1)) + 1  # Spark's bitmaps count from 1
    rows = frequent.select(F.bitmap_bucket_number(place).alias("b"), F.bitmap_bit_position(place).alias("p"))
    parts = rows.groupBy("b").agg(F.bitmap_construct_agg("p").alias("bitmap")).collect()
    found = bytearray(bits // 8)
    for part in parts:
        low = (part["b"] - 1) * 4096
        found[low : low + 4096] = part["bitmap"]
    return frequent.sparkSession.sparkContext.broadcast(bytes(found))


def _heavy(words: DataFrame, totals: DataFrame) -> dict[tuple[str, str], int]:
    """Words that make up a share of 1 in ``SHARES`` of all occurrences, and that many times their share: at most ``SHARES`` words."""
    total = totals.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    found = words.filter(F.col("n") * SHARES >= F.lit(total)).select("lang", "phrase", "n").collect()
    return {(r["lang"], r["phrase"]): -(-r["n"] * SHARES // total) for r in found}


def frequent(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, bits: int = FILTER_BITS, burst: int = BURST, most: int = MOST
) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, n) of all words and phrases with ``least`` occurrences, and (lang, total) of all words."""
    if bits < 32_768 or bits & (bits - 1):
        raise ValueError("bits is a power of two, 32768 at least")
    every = kept(counted(docs, (1,), burst=burst, most=most), "words")
    totals = kept(every.groupBy("lang").agg(F.sum("n").alias("total")), "totals")
    words = every.filter(F.col("n") >= least)
    heavy = _heavy(words, totals)
    word_bits = _shared_bits(words, _word_crc(F.col("phrase")), bits)
    found = [words]
    pairs = kept(counted(docs, (2,), word_bits, None, heavy, burst, most).filter(F.col("n") >= least), "pairs")
    found.append(pairs)
    if longest > 2:
        two = F.split("phrase", " ")
        pair_bits = _shared_bits(pairs, _pair_position(_word_crc(two[0]), _word_crc(two[1])), bits)
        longer = counted(docs, tuple(range(3, longest + 1)), word_bits, pair_bits, heavy, burst, most)
        found.append(kept(longer.filter(F.col("n") >= least), "longer"))
    together = found[0]
    for more in found[1:]:
        together = together.unionByName(more)
    return together, totals


def collocations(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, percent: int = PERCENT, scale: int = SCALE,
    bits: int = FILTER_BITS, burst: int = BURST, most: int = MOST,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` candidates by score, a (descending), phrase."""
    counts, totals = frequent(docs, least, longest, bits, burst, most)
    counts = kept(counts, "frequent")
    candidates = counts.filter("size > 1").withColumn("words", F.split("phrase", " "))
    inner = F.explode(
        F.array(F.slice("words", F.lit(1), F.col("size") - 1), F.slice("words", F.lit(2), F.col("size") - 1))
    )
    within = candidates.filter("size > 2").select("lang", "n", inner.alias("part")).select(
        "lang", F.array_join("part", " ").alias("phrase"), "n"
    )
    longer = within.groupBy("lang", "phrase").agg(F.max("n").alias("in_longer"))
    stays = kept(
        candidates.join(longer, ["lang", "phrase"], "left").filter(
            F.col("in_longer").isNull() | (100 * F.col("in_longer") < percent * F.col("n"))
        ).select("lang", "phrase", "words", "size", F.col("n").alias("a")),
        "candidates",
    )
    cut = F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    cuts = kept(
        stays.select("*", cut).select(
            "lang", "phrase", "a", "k",
            F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("first"),
            F.array_join(F.slice("words", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("rest"),
        ),
        "cuts",
    )
    first = counts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    rest = counts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    met = cuts.join(first, ["lang", "first"]).join(rest, ["lang", "rest"]).join(totals, "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    scored = met.withColumn("share", F.lit(scale).cast("decimal(10,0)") * wide("a"))
    score = F.expr("(share * CAST(total AS DECIMAL(19,0))) DIV (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))")
    lowest = scored.select("lang", "phrase", "a", "k", "l", "r", F.col("total").alias("n"), score.alias("score")).groupBy(
        "lang", "phrase", "a", "n"
    ).agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    order = W.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    return lowest.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top).select(
        "lang", "rank", "phrase", "a", "cut.l", "cut.r", "n", F.col("cut.score").cast("long").alias("score")
    )
