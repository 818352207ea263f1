"""Array kernels over the bytes of many texts at once.

A batch of texts is one byte buffer with offsets (as Arrow stores it). Words, lines and windows are found and
hashed with NumPy over that buffer, so no Python loop runs per word. Hashes are 64 bits and equal strings have equal
hashes in every process. Strings of up to eight bytes of one length never collide. Longer ones are sums of mixed
eight-byte grams times powers, whose mixing leaves no linear structure to cancel out (as bytes times powers would for
Thue-Morse strings); different ones are taken to collide with a chance of about 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of texts that are worked on at once: each takes over a hundred bytes of memory.
CHUNK = 1 << 18
_rng = np.random.default_rng(20240229)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Masks of the first 0 to 8 bytes of a little-endian gram.
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], U)
_STEP = U(0x9E3779B97F4A7C15 | 1)
_BACK = U(pow(int(_STEP), -1, 1 << 64))
_COMBINE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | U(1)
#: Bytes that stand in words: all but the blanks 0x20 and 0x09 to 0x0D.
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes that stand in words of letters and digits: ASCII letters and digits, and all of non-ASCII characters.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """STEP**i and STEP**-i for i to n, modulo 2**64."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, CHUNK + 1)
        steps, backs = np.full(size, _STEP, U), np.full(size, _BACK, U)
        steps[0] = backs[0] = 1
        with np.errstate(over="ignore"):
            made = [np.cumprod(steps, dtype=U), np.cumprod(backs, dtype=U)]
        if size > 8 * CHUNK:  # a very long text: not kept
            return made[0], made[1]
        _powers[:] = made
    return _powers[0], _powers[1]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def pieces(column: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts of about ``most`` bytes; a longer text comes alone."""
    data, offs = buffers(column)
    at, n = 0, len(offs) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
        yield at, to, data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to


def runs(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of the maximal runs of bytes that are inside; a run ends with its text."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(n + 1, bool)
    before[0], before[1:] = False, inside
    edge = offs[(offs > 0) & (offs < n)]
    starts = inside & ~before[:-1]
    starts[edge] = inside[edge]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    ends[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


class Sums:
    """The eight-byte grams of a buffer and prefix sums of mixed ones times powers; ``spans`` hashes substrings with them."""

    def __init__(self, data: np.ndarray, lower: bool):
        n = len(data)
        padded = np.zeros(n + 8, np.uint8)
        padded[:n] = _LOWER[data] if lower else data
        self.grams = np.ndarray(n + 1, "<u8", padded, 0, (1,)).copy()
        up, self.back = powers(n)
        self.prefix = np.empty(n + 1, U)
        self.prefix[0] = 0
        np.cumsum(mix(self.grams[:n]) * up[:n], out=self.prefix[1:])


def spans(sums: Sums, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte strings from starts to ends."""
    size = ends - starts
    least = size.min(initial=9)
    made = (sums.prefix[np.maximum(ends - 7, starts) if least < 7 else ends - 7] - sums.prefix[starts]) * sums.back[starts]
    if least <= 8:
        made = np.where(size > 8, made, sums.grams[starts] & _MASK[np.minimum(size, 8)])
    made += size.astype(U) * _COMBINE[0]
    return mix(made)


def words(data: np.ndarray, offs: np.ndarray, lower: bool = False, alphabet: np.ndarray = NOT_BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, start, end) of each word, in order."""
    starts, ends, text = runs(alphabet[data], offs)
    return spans(Sums(data, lower), starts, ends), text, starts, ends


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each k neighbours, regardless of texts; k - 1 fewer than given, none if there are too few."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    total = hashes[:n] * _COMBINE[1]
    for j in range(1, k):
        total += hashes[j : n + j] * _COMBINE[j + 1]
    return mix(total)


def shingles(hashes: np.ndarray, text: np.ndarray, n_texts: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each k-word shingle; a text of fewer words, but some, has its whole sequence as its one shingle."""
    made = grams(hashes, k)
    at = np.flatnonzero(text[: len(made)] == text[k - 1 :]) if len(made) else np.zeros(0, np.int64)
    found, owner = made[at], text[at]
    counts = np.bincount(text, minlength=n_texts)
    firsts = np.cumsum(counts) - counts
    short = []
    for m in range(1, k):
        if len(own := np.flatnonzero(counts == m)):
            total = np.zeros(len(own), U)
            for j in range(m):
                total += hashes[firsts[own] + j] * _COMBINE[j + 1]
            short.append((mix(total), own))
    if short:
        found = np.concatenate([found, *(s[0] for s in short)])
        owner = np.concatenate([owner, *(s[1] for s in short)])
        order = np.argsort(owner, kind="stable")
        found, owner = found[order], owner[order]
    return found, owner


def distinct(values: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each owner's distinct values, ascending, joined; and n + 1 offsets. owner ascends."""
    bounds = np.searchsorted(owner, np.arange(n + 1))
    out = values.copy()
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a > 1:
            out[a:b].sort()
    if len(out):
        keep = np.ones(len(out), bool)
        keep[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
        out, bounds = out[keep], np.concatenate([[0], np.cumsum(keep)])[bounds]
    return out, bounds
