"""Vectorised text primitives for Arrow batches: words, word hashes, shingle hashes and character q-grams.

All functions work on the UTF-8 buffer that Arrow hands over, in slices of bounded size, so that a task's memory
doesn't depend on the number of rows in a batch. Texts are never cut; a text larger than a slice is a slice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once.
SLICE = 1 << 19

MULT = np.uint64(0x9E3779B97F4A7C15)
BASE = 0xD1342543DE82EF95
BASE_INV = pow(BASE, -1, 1 << 64)

#: Bytes that separate words: space and 0x09 to 0x0D.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Each byte; A-Z as a-z.
FOLDED = np.arange(256, dtype=np.uint8)
FOLDED[0x41:0x5B] += 0x20
#: Ranges of more bytes are hashed one by one.
LONG = 64
#: A value for each of the LONG / 8 eight-byte words of a range.
KEYS = np.random.default_rng(20240229).integers(1, 1 << 63, LONG // 8, dtype=np.uint64)

_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE (or its inverse) to the powers 0 to n - 1, modulo 2**64."""
    key = "inv" if inverse else "pow"
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(n, SLICE + 1)
        step = np.full(size, BASE_INV if inverse else BASE, dtype=np.uint64)
        step[0] = 1
        have = _powers[key] = np.multiply.accumulate(step)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all bits."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


class Slice(NamedTuple):
    """Some consecutive texts of a batch: rows first to last - 1; ``bounds`` are byte offsets into ``data``."""

    first: int
    last: int
    data: np.ndarray
    bounds: np.ndarray


def slices(column: pa.Array, most: int = SLICE) -> Iterator[Slice]:
    """The texts of a string column in slices of about ``most`` bytes; null is as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    if not wide and not pa.types.is_string(column.type):
        column, wide = column.cast(pa.large_string()), True
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    at = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
        yield Slice(i, j, raw[at[i] : at[j]], at[i : j + 1] - at[i])
        i = j


class Words(NamedTuple):
    """``start`` and ``end`` are byte offsets in the slice; ``first`` has the number of the first word of each text, and one more."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


def words(part: Slice, space: np.ndarray = IS_SPACE) -> Words:
    """Runs of bytes that aren't white space (or ``space``, a flag for each byte); runs end where a text ends."""
    data = part.data
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(len(part.bounds), np.int64))
    solid = ~space[data]
    opens = solid.copy()
    opens[1:] &= ~solid[:-1]
    closes = solid.copy()
    closes[:-1] &= ~solid[1:]
    inner = part.bounds[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    opens[inner] = solid[inner]
    closes[inner - 1] = solid[inner - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return Words(start, end, np.searchsorted(start, part.bounds))


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; zeros follow the last byte."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))


def low_bytes(n: np.ndarray) -> np.ndarray:
    """Masks of the lowest n bytes, 8 at most."""
    return np.uint64(0xFFFFFFFFFFFFFFFF) >> ((8 - np.minimum(n, 8)).astype(np.uint64) * np.uint64(8))


def range_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, equal for equal bytes wherever they stand. No two ranges of one length up to 8 bytes share one.

    Every eight bytes are mixed before they are joined, and long ranges have a digest, so there is no structure of texts (as there is for
    sums of powers) that gives different ranges one hash.
    """
    n = end - start
    h = mix(n.astype(np.uint64) * MULT)
    view = eights(data)
    left = np.flatnonzero((n > 0) & (n <= LONG))
    for j in range(LONG // 8):
        if j:
            left = left[n[left] > 8 * j]
        if not len(left):
            break
        word = view[start[left] + 8 * j] & low_bytes(n[left] - 8 * j)
        h[left] = (h[left] ^ mix(word ^ KEYS[j])) * MULT
    for i in np.flatnonzero(n > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return mix(h)


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether the ranges of n bytes from a and from b are equal."""
    view, out = eights(data), np.ones(len(a), dtype=bool)
    left, j = np.flatnonzero((a != b) & (n > 0)), 0
    while len(left):
        differ = ((view[a[left] + j] ^ view[b[left] + j]) & low_bytes(n[left] - j)) != 0
        out[left[differ]] = False
        j += 8
        left = left[~differ & (n[left] > j)]
    return out


def word_hashes(part: Slice, found: Words) -> np.ndarray:
    """Hashes of the words with A-Z as a-z."""
    return range_hash(FOLDED[part.data], found.start, found.end)


def shingle_hashes(hashes: np.ndarray, first: np.ndarray, k: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words within a text, and the number of each text's first one (and one more).

    A text of 1 to k - 1 words gives one shingle of all its words if ``short``, else none.
    """
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, np.where(n > 0, 1, 0) if short else 0)
    at = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(int(at[-1]), dtype=np.uint64)
    if not len(out):
        return out, at
    padded = np.concatenate([hashes, np.zeros(k, np.uint64)])
    text = np.repeat(np.arange(len(n)), count)
    pos = np.arange(len(out)) - at[text] + first[text]
    left = first[text + 1] - pos
    h = np.full(len(out), k, dtype=np.uint64)
    for i in range(k):
        w = padded[pos + i]
        if i:
            w = np.where(left > i, w, np.uint64(0))
        h = (h ^ w) * MULT
        h ^= h >> np.uint64(29)
    return mix(h), at


def field(column: pa.Array, name: str) -> pa.Array:
    """A text field of a struct column, without a second copy of the texts on the way to Python."""
    out = pc.struct_field(column, name)
    return out if pa.types.is_string(out.type) or pa.types.is_large_string(out.type) else out.cast(pa.string())

