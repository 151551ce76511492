"""Shingle sets and MinHash signatures of texts, computed in NumPy inside a task."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import xxhash

WORD = re.compile(r"\w+")
CACHED_WORDS = 200_000
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x9E3779B97F4A7C15)
    x = x ^ (x >> U64(29))
    x = x * U64(0xBF58476D1CE4E5B9)
    return x ^ (x >> U64(32))


class WordHashes(dict):
    """Hash of each word; forgets everything when it has grown too large."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def rolling(values: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of ``size`` neighbouring values, not scrambled."""
    powers = np.array([pow(0x100000001B3, k, 1 << 64) for k in range(size)], dtype=U64)
    n = len(values) - size + 1
    total = np.zeros(n, U64)
    for k in range(size):
        total += values[k:k + n] * powers[k]
    return total


def _windows(values: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``size`` values inside each text, and where each text's begin.

    ``values`` are the values of all texts, one after the other, each followed by size - 1 zeros; a shorter
    text is one window. Lengths are positive.
    """
    total = rolling(values, size)
    windows = np.maximum(lengths - size + 1, 1)
    starts = np.cumsum(windows) - windows
    first = np.cumsum(lengths + size - 1) - (lengths + size - 1)
    at = np.repeat(first - starts, windows) + np.arange(windows.sum())
    return mix(total[at]), starts


def distinct(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, value) of the distinct shingles of fewer than 2 ** 20 texts, told apart by the first 44 bits of their hashes."""
    text = np.repeat(np.arange(len(starts), dtype=U64), np.diff(np.r_[starts, len(hashes)]))
    both = text << U64(44) | hashes >> U64(20)
    both.sort()
    both = both[np.r_[True, both[1:] != both[:-1]]]
    return (both >> U64(44)).astype(np.int64), (both & U64((1 << 44) - 1)).astype(np.int64)


@dataclass(frozen=True)
class WordShingles:
    """Runs of ``size`` words, lower case and without punctuation; a shorter text is one shingle."""
    size: int = 5

    def normal(self, text: str) -> str:
        return " ".join(WORD.findall(text.lower()))

    def begin(self):
        hashes = WordHashes()

        def windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            """Shingle hashes of normal, non-empty texts and where each text's begin."""
            words = [t.split(" ") for t in texts]
            lengths = np.fromiter(map(len, words), np.int64, len(words))
            flat = np.fromiter(map(hashes.__getitem__, chain.from_iterable(words)), U64, int(lengths.sum()))
            values = np.zeros(len(flat) + len(words) * (self.size - 1), U64)
            values[np.arange(len(flat)) + np.repeat(np.arange(len(words)) * (self.size - 1), lengths)] = flat
            return _windows(values, lengths, self.size)
        return windows


@dataclass(frozen=True)
class CharShingles:
    """Runs of ``size`` characters, lower case, white space runs as one space; a shorter text is one shingle."""
    size: int = 7

    def normal(self, text: str) -> str:
        return " ".join(text.lower().split())

    def begin(self):
        gap = "\0" * (self.size - 1)

        def windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            joined = gap.join(texts) + gap
            values = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64)
            return _windows(values, np.fromiter(map(len, texts), np.int64, len(texts)), self.size)
        return windows


def fingerprint(normal: str) -> int:
    """A signed 64-bit value that stands for a normal text."""
    value = xxhash.xxh3_64_intdigest(normal.encode("utf-8", "surrogatepass"))
    return value - (1 << 64) if value >> 63 else value


@dataclass(frozen=True)
class Bands:
    """``bands`` bands of ``rows`` MinHash values.

    ``one_pass`` hashes each shingle once and deals it into one of bands * rows bins; otherwise each
    value has a hash function of its own. Every empty bin borrows from bins drawn for it alone, so that the
    values of a band stay apart in short texts (neighbours would borrow one value and pass as one row).
    """
    bands: int
    rows: int
    one_pass: bool = False
    seed: int = 20_231

    @property
    def values(self) -> int:
        return self.bands * self.rows

    def begin(self):
        rng = np.random.default_rng(self.seed)
        odd = rng.integers(1, 1 << 63, self.values, dtype=U64) | U64(1)
        weights = rng.integers(1, 1 << 63, (self.bands, self.rows), dtype=U64) | U64(1)
        salt = rng.integers(1, 1 << 63, self.bands, dtype=U64)
        n = self.values
        lenders = rng.integers(0, n, (24, n))

        def dealt(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
            row = np.zeros(len(hashes), np.int64)
            row[starts[1:]] = 1
            row = np.cumsum(row)
            at = row * n + ((hashes & U64(0xFFFFFFFF)) * U64(n) >> U64(32)).astype(np.int64)
            none = np.uint64(1 << 63)
            out = np.full(len(starts) * n, none, U64)
            np.minimum.at(out, at, hashes >> U64(32))
            out = out.reshape(-1, n)
            text, bin_ = np.nonzero(out == none)
            full = out.copy()
            for lender in lenders:
                if not len(text):
                    break
                lent = full[text, lender[bin_]]
                out[text, bin_] = lent
                still = lent == none
                text, bin_ = text[still], bin_[still]
            # What found no lender takes the next full bin round the circle, marked by the distance.
            spot = np.where(out != none, np.arange(n), 2 * n)
            twice = np.concatenate([spot, spot + n], axis=1)
            nxt = np.minimum.accumulate(twice[:, ::-1], axis=1)[:, ::-1][:, :n]
            away = nxt - np.arange(n)
            values = np.take_along_axis(out, nxt % n, axis=1) + (away * 0x9E3779B1 & 0xFFFFFFFF).astype(U64)
            return (values & U64(0xFFFFFFFF)).astype(np.uint32)

        def signatures(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
            """uint32 values, (texts, values), from the shingle hashes of non-empty texts."""
            out = np.empty((len(starts), n), np.uint32)
            ends = np.r_[starts[1:], len(hashes)]
            a = 0
            while a < len(starts):  # slices that fit the cache
                b = max(a + 1, int(np.searchsorted(ends, starts[a] + 50_000, "right")))
                part, first = hashes[starts[a]:ends[b - 1]], starts[a:b] - starts[a]
                if self.one_pass:
                    out[a:b] = dealt(part, first)
                else:
                    for k in range(n):
                        out[a:b, k] = (np.minimum.reduceat(part * odd[k], first) >> U64(32)).astype(np.uint32)
                a = b
            return out

        def keys(values: np.ndarray) -> np.ndarray:
            """Signed 64-bit band keys, (texts, bands), of signatures."""
            x = values.reshape(-1, self.bands, self.rows).astype(U64)
            return mix((mix(x + U64(1)) * weights).sum(axis=2) + salt).astype(np.int64)
        return signatures, keys


def sliced(batches: Iterator, rows: int = 500) -> Iterator:
    """The same rows in small batches, so that a task holds few long texts as Python strings at a time."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def chunks(texts: list[str], letters: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about so many characters in all."""
    a = size = 0
    for i, t in enumerate(texts):
        size += len(t) + 8
        if size >= letters:
            yield a, i + 1
            a, size = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


def pairs_within(groups: np.ndarray, sides: np.ndarray | None = None, most: int = 400_000):
    """Index pairs inside runs of equal group number; with ``sides`` (0, 1) only across sides.

    ``groups`` is sorted. Yields (left, right) arrays of at most about ``most`` pairs (more only
    for a single group, whose size the caller bounds).
    """
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    sizes = np.diff(np.r_[starts, len(groups)])
    for m in np.unique(sizes[sizes > 1]):
        i, j = np.triu_indices(m, 1)
        of_size = starts[sizes == m]
        each = max(1, most // len(i))
        for a in range(0, len(of_size), each):
            base = of_size[a:a + each, None]
            left, right = (base + i).ravel(), (base + j).ravel()
            if sides is not None:
                across = (sides[left] != sides[right]) | (sides[left] < 0)
                left, right = left[across], right[across]
            for b in range(0, len(left), most):
                yield left[b:b + most], right[b:b + most]


def roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest index connected to each of 0..n-1."""
    label = np.arange(n)
    while len(left):
        old = label.copy()
        low = np.minimum(label[left], label[right])
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        np.minimum.at(label, old[left], low)
        np.minimum.at(label, old[right], low)
        label = label[label]
        if (label == old).all():
            break
    return label


def shared(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Numbers of common elements of all pairs of a bounded list of sets."""
    m = len(sets)
    if m == 2:
        both = np.intersect1d(sets[0], sets[1], assume_unique=True).size
        return np.array([[len(sets[0]), both], [both, len(sets[1])]])
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = times > 1
    number = np.cumsum(common) - 1
    keep = common[column]
    owner, column = owner[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((m, m), np.float64)
    for a in range(0, int(common.sum()), columns):
        lo, hi = np.searchsorted(column, [a, a + columns])
        dense = np.zeros((m, columns), np.float32)
        dense[owner[lo:hi], column[lo:hi] - a] = 1
        total += dense @ dense.T
    out = total.astype(np.int64)
    np.fill_diagonal(out, [len(s) for s in sets])
    return out
