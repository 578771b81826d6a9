"""Words, lines and their hashes of a batch of whole texts, as arrays over the batch's UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: A batch is cut into blocks of about so many bytes; a longer text is a block of its own, never cut.
BLOCK_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_LETTERS = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, out=out)


class TextBlock:
    """Texts one after the other with a line feed behind each, so no word or line spans two texts."""

    def __init__(self, texts: list[str]):
        coded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.docs = len(coded)
        self.data = np.frombuffer(b"\n".join([*coded, b""]), np.uint8)
        ends = np.cumsum([len(c) + 1 for c in coded], dtype=np.int64) if coded else np.zeros(0, np.int64)
        self.bounds = np.concatenate([[0], ends])
        solid = ~SPACE[self.data]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], solid, [False]]).view(np.int8)))
        self.solid, self.starts, self.ends = solid, edge[::2], edge[1::2]
        self.word_doc = np.searchsorted(self.bounds, self.starts, "right") - 1
        self._sums = None

    def _hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if self._sums is None:
            n = len(self.data)
            self._sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_LETTERS[self.data] * _powers(_MULTIPLIER, n), out=self._sums[1:])
            self._back = _powers(_INVERSE, n + 1)
        value = (self._sums[ends] - self._sums[starts]) * self._back[starts]
        return mixed(value + (ends - starts).astype(np.uint64))

    def word_hashes(self) -> np.ndarray:
        """64 bits for each word, equal for equal words."""
        return self._hash(self.starts, self.ends)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, text number, hash) of each line; lines end at line feeds only."""
        ends = np.flatnonzero(self.data == 10)
        starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
        return starts, ends, np.searchsorted(self.bounds, starts, "right") - 1, self._hash(starts, ends)

    def per_doc(self, marks: np.ndarray) -> np.ndarray:
        """How many bytes of each text are marked."""
        total = np.concatenate([[0], np.cumsum(marks)])
        return total[self.bounds[1:]] - total[self.bounds[:-1]]

    def words_of(self) -> np.ndarray:
        return np.bincount(self.word_doc, minlength=self.docs)


def windows(words: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every run of ``size`` words within one text."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    value = np.zeros(n, np.uint64)
    for k in range(size):
        value = mixed(value + words[k : k + n])
    first = np.flatnonzero(doc[:n] == doc[size - 1 :])
    return first, value[first]


def blocks(texts: list) -> Iterator[tuple[int, int]]:
    """Ranges of texts that make blocks of bounded bytes."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        size = 4 * len(text) if text and not text.isascii() else len(text or "")
        if i > start and held + size > BLOCK_BYTES:
            yield start, i
            start, held = i, 0
        held += size + 1
    if len(texts) > start:
        yield start, len(texts)
