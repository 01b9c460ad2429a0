"""Word features computed in tasks: cached 64-bit word hashes and hashed n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

CACHE_WORDS = 1 << 20
_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xC2B2AE3D27D4EB4F)
_C = np.uint64(0x165667B19E3779F9)
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, computed on first use.  Bounded: emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


HASHES = WordHashes()


def lower_words(text: str | None) -> list[bytes]:
    """The words (runs of anything but blank and the control characters 9 to 13) of ``text``, A-Z
    lower-cased, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(HASHES.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble, so that hash order is unrelated to the words."""
    x = (x ^ (x >> np.uint64(31))) * _B
    return x ^ (x >> np.uint64(29))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * _A) | np.uint64(1)
_BYTE[ord("A"):ord("Z") + 1] = _BYTE[ord("a"):ord("z") + 1]
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_BACK = np.uint64(pow(int(_A), -1, 1 << 64))
_POWERS = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2^64, kept and grown on demand."""
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 14)
        for k, base in enumerate((_A, _BACK)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


def utf8_texts(column: pa.Array) -> Iterator[np.ndarray]:
    """The UTF-8 bytes of each text of an Arrow column, without copying (null: empty)."""
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset: column.offset + len(column) + 1] \
        if len(column) else np.zeros(1, dtype=np.int32)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.empty(0, dtype=np.uint8)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for ok, start, end in zip(valid.tolist(), offsets[:-1].tolist(), offsets[1:].tolist()):
        yield data[start:end] if ok else data[:0]


def hashed_words(text: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words of a text given as UTF-8 bytes, A-Z lower-cased: differences of one
    running polynomial sum over the bytes, moved to the same power."""
    if not len(text):
        return np.empty(0, dtype=np.uint64)
    power, back = _powers(len(text) + 1)
    inside = np.zeros(len(text) + 2, dtype=bool)
    np.logical_not(_BLANK[text], out=inside[1:-1])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    total = np.zeros(len(text) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[text] * power[: len(text)], out=total[1:])
    return mixed((total[end] - total[start]) * back[start])


def shingle_hashes(text: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``n`` words of a text given as UTF-8 bytes; fewer
    words are one run, no words none."""
    h = hashed_words(text)
    if not len(h):
        return h
    if len(h) < n:
        return mixed(np.array([xxhash.xxh3_64_intdigest(h.tobytes())], dtype=np.uint64))
    acc = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        acc = (acc * _A) ^ (h[i: len(h) - n + 1 + i] + _C * np.uint64(i))
        acc ^= acc >> np.uint64(32)
    acc = mixed(acc)
    acc.sort()
    return acc[np.concatenate(([True], acc[1:] != acc[:-1]))]
