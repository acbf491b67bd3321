"""Distinct word shingles of whole texts as sorted 64-bit hashes, computed over bytes without a loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK_BYTES = 1_000_000

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_LOWER += 1
_ODD = np.random.default_rng(20240229).integers(0, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _words(contents: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, words of each text)."""
    raw = np.frombuffer(b"\n".join(contents) + b"\n", np.uint8)
    space = _SPACE[raw]
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    first = np.cumsum([0, *(len(c) + 1 for c in contents[:-1])])
    counts = np.bincount(np.searchsorted(first, starts, "right") - 1, minlength=len(contents))
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    body = _LOWER[raw[~space]]
    at = np.cumsum(~space)[starts] - 1
    length = np.diff(np.append(at, len(body)))
    place = np.arange(len(body)) - np.repeat(at, length)
    body *= _ODD[place & 4095]
    if length.max() > 4096:
        body *= (place >> 12).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    return mixed(np.add.reduceat(body, at) + length.astype(np.uint64)), counts


def shingle_sets(texts, size: int) -> Iterator[np.ndarray]:
    """One sorted array per text: its distinct shingles of ``size`` words, A-Z in lower case.

    A text of fewer words has its whole sequence as one shingle; without words the array is empty.
    """
    chunk, total = [], 0
    for text in texts:
        content = (text or "").encode("utf-8", "surrogatepass")
        if chunk and total + len(content) > CHUNK_BYTES:
            yield from _sets(chunk, size)
            chunk, total = [], 0
        chunk.append(content)
        total += len(content)
    if chunk:
        yield from _sets(chunk, size)


def _sets(contents: list[bytes], size: int) -> Iterator[np.ndarray]:
    words, counts = _words(contents)
    window = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for n in range(size):
        window = mixed(window + words[n : n + len(window)] * np.uint64(2 * n + 1))
    ends = np.cumsum(counts)
    for end, count in zip(ends, counts):
        start = end - count
        if count >= size:
            yield np.unique(window[start : end - size + 1])
        elif count:
            whole = np.uint64(count)
            for word in words[start:end]:
                whole = _step(whole, word)
            yield np.array([whole], np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def _step(state, word):
    return mixed(np.array([state], np.uint64) * np.uint64(3) + word)[0]
