"""Encoding of whole texts by a public tokenizer, with a cache of encoded runs.

``word_bpe_49k`` drops white space and never joins characters across it, so a text's ids are the ids
of its pieces between spaces and line ends, one after the other. A word of Latin letters and plain punctuation
needs no normalizer but lower case and splits into runs of letters and runs of others. A chunk of texts
is cut into runs by the kinds of its UTF-8 bytes and its runs are numbered by Arrow, so that Python
sees each distinct run of a chunk once. New runs go to the library's model in
one call, whose ids are cut after each id that ends a run; every other word is a run of its own that takes the
library's whole chain.

All of this rests on the normalizer, splitter and special tokens of that file. A tokenizer with others encodes
whole texts by the library alone.
"""

from __future__ import annotations

import codecs
import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa

from tidegrid.llm.common import WORKER_CACHES

CACHED_RUNS = 500_000
CHUNK_CHARS = 4_000_000

#: Kinds of bytes: spaces and line ends, Latin letters, plain punctuation, and bytes whose words are not plain.
SPACE, LETTER, OTHER, ODD = range(4)
_PUNCTUATION = b"!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"  # without ' (contractions) and < (special tokens)
_KINDS = np.full(256, ODD, np.uint8)
_KINDS[[10, 32]] = SPACE
_KINDS[[*range(65, 91), *range(97, 123)]] = LETTER
_KINDS[list(_PUNCTUATION)] = OTHER
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)

#: The normalizers and splitters, and the pattern between words, with which words can be encoded one by one.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
SPLITTERS = ["Split", "ByteLevel"]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
RUN_END = "</w>"
MODEL_CALL = 1000


def _byte_characters() -> str:
    """The byte-level alphabet: printable bytes stand for themselves, the rest follow from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in printable]
    return "".join(chr(b if b in printable else 256 + rest.index(b)) for b in range(256))


_BYTES = _byte_characters()


class _Index(dict):
    """Run to number; unknown runs get the next number and wait to be encoded."""

    def __init__(self):
        super().__init__()
        self.waiting: list[bytes] = []

    def __missing__(self, run):
        number = len(self)
        self[run] = number
        self.waiting.append(run)
        return number


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of all ranges, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


class _Ids:
    """Lists of ids by number, one after the other in one array."""

    def __init__(self):
        self.flat = np.zeros(0, np.uint32)
        self.starts, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, ids: np.ndarray, lengths: np.ndarray):
        starts = len(self.flat) + np.cumsum(lengths) - lengths
        self.flat = np.concatenate([self.flat, ids])
        self.starts, self.lengths = np.concatenate([self.starts, starts]), np.concatenate([self.lengths, lengths])

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths) of these lists."""
        lengths = self.lengths[numbers]
        return self.flat[_ranges(self.starts[numbers], lengths)], lengths


def _runs(content: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, borders, kinds) of the runs of UTF-8 bytes, plain ones in lower case.

    A word with an odd byte is one run; so are spaces and line ends between words.
    """
    data = np.frombuffer(content, np.uint8)
    kinds = _KINDS[data]
    latin = np.flatnonzero(data == 0xC3)  # À to ÿ, without the signs × and ÷
    latin = latin[(data[latin + 1] != 0x97) & (data[latin + 1] != 0xB7)]
    kinds[latin] = kinds[latin + 1] = LETTER
    low = _LOWER[data]
    low[latin + 1] += np.where(data[latin + 1] <= 0x9E, 32, 0).astype(np.uint8)  # À to Þ
    odd = kinds == ODD
    if odd.any():
        starts = np.append(0, np.flatnonzero(kinds == SPACE))  # of words with the space before them
        words = np.logical_or.reduceat(odd, starts)
        odd = np.repeat(words, np.diff(starts, append=len(data))) & (kinds != SPACE)
        kinds[odd] = ODD
        np.copyto(low, data, where=odd)
    borders = np.concatenate([[0], np.flatnonzero(kinds[1:] != kinds[:-1]) + 1, [len(data)]])
    return low, borders, kinds[borders[:-1]]


def _by_words(tokenizer) -> bool:
    """Whether this tokenizer's ids of a text are those of its words, one after the other."""
    parts = json.loads(tokenizer.to_str())
    normalizer, splitter, model = (parts.get(name) or {} for name in ("normalizer", "pre_tokenizer", "model"))
    steps, cuts = normalizer.get("normalizers", []), splitter.get("pretokenizers", [])
    added = [token["content"] for token in parts.get("added_tokens", [])]
    return (
        [step["type"] for step in steps] == NORMALIZERS
        and (steps[1]["pattern"], steps[1]["content"]) == ({"Regex": r"\s+"}, " ")
        and [cut["type"] for cut in cuts] == SPLITTERS
        and cuts[0]["pattern"] == {"Regex": PATTERN}
        and (cuts[0]["behavior"], cuts[0]["invert"]) == ("Removed", True)
        and not cuts[1]["add_prefix_space"]
        and not cuts[1]["use_regex"]
        and model.get("type") == "BPE"
        and model.get("end_of_word_suffix") == RUN_END
        and not model.get("dropout")
        and parts.get("truncation") is None
        and all("<" in content and not re.search(r"\s", content) for content in added)
    )


class WordEncoder:
    """``encode(texts)`` yields one array of uint32 ids per text (null: empty), in order."""

    def __init__(self, path: str, cached_words: int = CACHED_RUNS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self.by_words = _by_words(self._tokenizer)
        if self.by_words:
            self._model = Tokenizer(self._tokenizer.model)  # takes spelled runs as they are
            self._ends = np.zeros(self._tokenizer.get_vocab_size(), bool)
            for token, number in self._model.get_vocab(with_added_tokens=False).items():
                self._ends[number] = token.endswith(RUN_END)
        self._cached_words = cached_words
        self._forget()

    def _forget(self):
        self._index, self._ids = _Index(), _Ids()

    def _spelled(self, runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths) of plain runs."""
        if not runs:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        spelled = codecs.charmap_decode(b"\n".join(runs), "strict", _BYTES)[0].split(_BYTES[10])
        calls = [spelled[at : at + MODEL_CALL] for at in range(0, len(spelled), MODEL_CALL)]
        made = self._model.encode_batch_fast(calls, is_pretokenized=True, add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(each.ids for each in made), np.uint32)
        lengths = np.diff(np.flatnonzero(self._ends[ids]), prepend=-1)
        if len(lengths) != len(runs) or lengths.sum() != len(ids):
            raise ValueError("the vocabulary does not spell every run")
        return ids, lengths

    def _learn(self, kinds: np.ndarray):
        """Encode the waiting runs, of these kinds."""
        runs, self._index.waiting = self._index.waiting, []
        plain = (kinds == LETTER) | (kinds == OTHER)
        ids, lengths = self._spelled([run for run, each in zip(runs, plain.tolist()) if each])
        if not plain.all():
            odd = (run.decode() if kind == ODD else "" for run, kind in zip(runs, kinds.tolist()) if kind in (SPACE, ODD))
            others = [self._tokenizer.encode(word, add_special_tokens=False).ids if word else [] for word in odd]
            counts = np.zeros(len(runs), np.int64)
            counts[plain], counts[~plain] = lengths, list(map(len, others))
            rare, both = np.repeat(~plain, counts), np.zeros(counts.sum(), np.uint32)
            both[~rare], both[rare] = ids, list(chain.from_iterable(others))
            ids, lengths = both, counts
        self._ids.add(ids, lengths)

    def _chunk(self, texts):
        contents = [text.encode() for text in texts]
        content = b"\n".join(contents)
        if not content:
            return [np.zeros(0, np.uint32) for _ in texts]
        low, borders, kinds = _runs(content)
        buffers = [None, pa.py_buffer(borders), pa.py_buffer(low)]
        runs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(kinds), buffers).dictionary_encode()
        inside = runs.indices.to_numpy()
        kind_of = np.zeros(len(runs.dictionary), np.uint8)
        kind_of[inside] = kinds
        known = len(self._index)
        numbers = np.fromiter(map(self._index.__getitem__, runs.dictionary.to_pylist()), np.int64, len(kind_of))
        self._learn(kind_of[numbers >= known])
        ids, lengths = self._ids.of(numbers[inside])
        ends = np.append(0, np.cumsum(lengths))
        starts = np.cumsum([len(each) + 1 for each in contents])[:-1]
        if len(self._index) > self._cached_words:
            self._forget()
        return np.split(ids, ends[np.searchsorted(borders, starts)])

    def encode(self, texts):
        if not self.by_words:
            for text in texts:
                yield np.array(self._tokenizer.encode(text or "", add_special_tokens=False).ids, np.uint32)
            return
        chunk, chars = [], 0
        for text in texts:
            text = text or ""
            if chunk and chars + len(text) > CHUNK_CHARS:
                yield from self._chunk(chunk)
                chunk, chars = [], 0
            chunk.append(text)
            chars += len(text)
        if chunk:
            yield from self._chunk(chunk)


_ENCODERS: dict[str, WordEncoder] = {}
WORKER_CACHES["tokens"] = _ENCODERS.clear


def encoder(path: str) -> WordEncoder:
    """One encoder per Python worker, kept from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
