"""Numpy operations over the UTF-8 bytes of an Arrow batch of texts.

Whole texts are worked on, a slice of rows at a time, so that the temporary arrays stay near
``SLICE`` bytes times a small factor (one text longer than that is a slice of its own).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 18
#: Spans of more bytes are hashed one by one.
LONG = 64
U64 = np.uint64
#: An odd multiplier, so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)

SEPARATORS = np.zeros(256, bool)
SEPARATORS[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: ASCII letters and every byte of a non-ASCII character.
LETTERS = np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def slices(texts: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offset of each row and the end) for each slice; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    if not len(texts):
        return
    wide = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    offs = np.frombuffer(texts.buffers()[1], wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i, n = 0, len(texts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def spans(mask: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of set bytes; runs end where rows do."""
    n = len(mask)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    cut = np.zeros(n + 1, bool)
    cut[offs[:-1]] = True
    before = np.concatenate(([False], mask[:-1]))
    starts = np.flatnonzero(mask & (~before | cut[:n]))
    after = np.concatenate((mask[1:], [False]))
    ends = np.flatnonzero(mask & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i below n."""
    global _POWERS
    if len(_POWERS[0]) < n:
        size = 1 << max(10, int(n - 1).bit_length())
        with np.errstate(over="ignore"):
            _POWERS = tuple(np.multiply.accumulate(np.concatenate((np.ones(1, U64), np.full(size - 1, x, U64)))) for x in (BASE, INVERSE))
    return _POWERS[0][:n], _POWERS[1][:n]


_POWERS: tuple = (np.ones(1, U64), np.ones(1, U64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """Prefix sums of byte times BASE**position, from which the hash of any span follows."""
    up, _ = powers(len(buf) + 1)
    out = np.zeros(len(buf) + 1, U64)
    with np.errstate(over="ignore"):
        np.cumsum((buf.astype(U64) + U64(1)) * up[:-1], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums))
    with np.errstate(over="ignore"):
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span. Long buffers are worked on piece by piece; spans never straddle two pieces."""
    if len(buf) <= 16 * SLICE or not len(starts):
        return span_hashes(prefix_sums(buf), starts, ends)
    out, i = np.empty(len(starts), U64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + 16 * SLICE, "right")))
        lo, hi = starts[i], ends[j - 1]
        out[i:j] = span_hashes(prefix_sums(buf[lo:hi]), starts[i:j] - lo, ends[i:j] - lo)
        i = j
    return out


def chained_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span, 8 bytes at a time with a mix behind each; spans of over LONG bytes get a digest.

    Spans of equal length up to 8 bytes never collide. A polynomial modulo 2**64 (word_hashes) maps a Thue-Morse word of 2048
    letters and its complement to one value, whatever the base.
    """
    size = ends - starts
    eight = np.ndarray(len(buf), "<u8", np.concatenate((buf, np.zeros(8, np.uint8))), strides=(1,))
    out = mix(size.astype(U64) + U64(BASE))
    at = np.flatnonzero(size <= LONG)
    for k in range(0, LONG, 8):
        at = at[size[at] > k]
        if not len(at):
            break
        left = np.minimum(size[at] - k, 8).astype(U64)
        out[at] = mix(out[at] ^ (eight[starts[at] + k] & (U64(2**64 - 1) >> (U64(64) - U64(8) * left))))
    for i in np.flatnonzero(size > LONG):
        out[i] = int.from_bytes(hashlib.blake2b(buf[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return out


#: Odd multipliers, one for each place in an n-gram.
PLACES = mix(np.arange(1, 65, dtype=U64) * U64(0xD1342543DE82EF95)) | U64(1)


def grams(hashes: np.ndarray, rows: np.ndarray, n: int, gaps: tuple[int, ...] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each n-gram of words within a row and the index of its first word; gaps: the words' places, 0 to n - 1 if None."""
    at = gaps or tuple(range(n))
    m = len(hashes) - at[-1]
    if m <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        g = np.full(m, U64(n * 64 + at[-1]))
        for k, p in enumerate(at):
            g = g + hashes[p : p + m] * PLACES[k]
    ok = np.flatnonzero(rows[:m] == rows[at[-1] :])
    return mix(g[ok]), ok


def shingle_sets(texts: pa.Array, n: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct 64-bit hashes of its n-word shingles), A-Z lower-cased; with fewer words the whole sequence is one."""
    for i, j, buf, offs in slices(texts):
        low = LOWER[buf]
        starts, ends, rows = spans(~SEPARATORS[low], offs)
        words = chained_hashes(low, starts, ends)
        first = np.searchsorted(rows, np.arange(j - i + 1))
        many, at = grams(words, rows, n)
        where = np.searchsorted(at, first)
        for k in range(j - i):
            a, b = first[k], first[k + 1]
            if b - a >= n:
                yield i + k, np.unique(many[where[k] : where[k + 1]])
            elif b > a:
                yield i + k, grams(words[a:b], rows[a:b], int(b - a))[0]
            else:
                yield i + k, np.zeros(0, U64)


def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column from numpy arrays."""
    offs = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=offs[1:])
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(flat).cast(kind) if flat.dtype != U64 else pa.array(flat.view(np.int64)))
