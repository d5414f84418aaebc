"""Vectorised word work on batches of texts: one buffer of bytes, numpy arrays of word bounds and 64-bit hashes.

A word is a run of bytes outside 0x20 and 0x09-0x0D, which on UTF-8 is the pattern ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
MASK = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [2**64 - 1], np.uint64)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Bytes of text that are worked on at once; a longer text is a chunk of its own.
CHUNK = 4 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection on 64 bits."""
    x = x + _A
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span; buf needs 8 bytes of padding after the last span."""
    rows = np.lib.stride_tricks.sliding_window_view(buf, 8)
    h = mix((ends - starts).astype(np.uint64))
    live, pos, left = None, starts, ends - starts
    while len(pos):
        x = rows[pos].view("<u8").ravel() & MASK[np.minimum(left, 8)]
        if live is None:
            h = mix(h ^ x)
            live = np.flatnonzero(left > 8)
            pos, left = pos[live] + 8, left[live] - 8
        else:
            h[live] = mix(h[live] ^ x)
            more = left > 8
            live, pos, left = live[more], pos[more] + 8, left[more] - 8
    return h


@dataclass
class Words:
    """buf: all texts, each after a newline; first[i]:first[i+1] are the words of text i; at[i]: its first byte."""

    buf: np.ndarray
    at: np.ndarray
    size: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def n(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return hash_spans(self.buf, self.starts, self.ends)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at)), self.n)

    def per_text(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each text are set in mask, an array like buf."""
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return total[self.at + self.size] - total[self.at]


def words(texts: list[bytes | None], lower: bool = False, between: np.ndarray = SPACE) -> Words:
    """Split texts at the bytes set in between, a newline among them; null counts as empty. lower: A-Z to a-z, no other
    letters."""
    texts = [t or b"" for t in texts]
    joined = b"\n" + b"\n".join(texts) + b"\n" + b"\n" * 8
    if lower:
        joined = joined.lower()
    buf = np.frombuffer(joined, np.uint8)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    at = 1 + np.concatenate([[0], np.cumsum(size[:-1] + 1)]) if len(texts) else np.zeros(0, np.int64)
    space = between[buf]
    turn = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = turn[0::2], turn[1::2]
    first = np.append(np.searchsorted(starts, at), len(starts))
    return Words(buf, at, size, starts, ends, first)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k hashes from each place on; len(h) - k + 1 of them."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    acc = h[:m].copy()
    for j in range(1, k):
        acc *= _B
        acc += h[j : j + m]
    return mix(acc)


def inside(first: np.ndarray, k: int, m: int) -> np.ndarray:
    """Which of the m places have all of their k words in one text."""
    left = np.repeat(first[1:], np.diff(first))[:m] - np.arange(m)
    return left >= k


def chunks(rows: list[bytes | None], limit: int = CHUNK):
    """Index ranges of rows with about limit bytes each."""
    lo = size = 0
    for i, t in enumerate(rows):
        size += len(t or b"")
        if size >= limit:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(rows):
        yield lo, len(rows)


def texts_of(batch, name: str = "text") -> list[bytes | None]:
    """A batch's string column as bytes, without decoding."""
    import pyarrow as pa

    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()
