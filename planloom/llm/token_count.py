"""Operator 10: token counts of whole texts, equal to the tokenizer library's.

Huge texts are encoded in overlapping chunks with offsets. The pre-tokenizer of a byte-level BPE reads from left to
right, and what it makes of the text from a position on depends on nothing before it. So where the chunk on the left has
a word boundary, far enough from its end that nothing beyond the chunk can move it, and the chunk on the right has one
at the same place, the right chunk's tokens from there on are those of the whole text: the counts are spliced there.
Where an overlap has no common boundary, the left chunk and the overlap are doubled, and stay so until they splice: so a text
without boundaries costs a few times its length, and not its length times its chunks.

Other texts are spliced at boundaries that need no second encoding: a space after a character that is no white space
always begins a new word, so a text's count is the sum of the counts of its pieces from one such space to the next. The
library counts each different piece once a worker process (within a bound); the rest is a look-up. Pieces are told apart by their bytes: hashes
only gather those of a slice, and each is compared with the one that it is counted by.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .workspace import ship

#: Texts of more UTF-8 bytes are encoded in overlapping chunks.
HUGE = 1 << 15
#: Characters of a chunk and of the first overlap.
CHUNK, OVERLAP = 1 << 13, 1 << 8
#: A boundary this close to a chunk's end isn't used: longer than any special string and any look-ahead.
GUARD = 64
#: Different pieces whose counts a process keeps, and the bytes that one of them may have.
MEMO, MEMO_BYTES = 1 << 19, 64

_loaded: dict[str, object] = {}
_counted: dict[str, dict[bytes, int]] = {}


def tokenizer(path: str):
    """The library's tokenizer for a file, loaded once a process, with offsets that keep leading spaces."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _loaded[path] = t
    return _loaded[path]


def _boundaries(enc) -> tuple[np.ndarray, np.ndarray]:
    """Start offsets of the words and the numbers of their first tokens."""
    ids = np.array([-1 if w is None else w for w in enc.word_ids], dtype=np.int64)
    if not len(ids):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (ids[1:] < 0)]))
    return np.array([o[0] for o in enc.offsets], dtype=np.int64)[first], first


def _splice(left, left_start: int, begin: int, left_end: int, right, right_start: int) -> tuple[int, int] | None:
    """The tokens at which two chunks change over: the last boundary that both have and that nothing beyond the left one can move."""
    (at, first), (b_at, b_first) = _boundaries(left), _boundaries(right)
    at, b_at = at + left_start, b_at + right_start
    usable = (at > right_start) & (at <= left_end - GUARD) & (first >= begin)
    common = np.intersect1d(at[usable], b_at)
    if not len(common):
        return None
    return int(first[np.searchsorted(at, common[-1])]), int(b_first[np.searchsorted(b_at, common[-1])])


def count_huge(t, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a text by overlapping chunks; equal to ``len(t.encode(text, add_special_tokens=False))``."""
    n = len(text)
    overlap = max(min(overlap, chunk // 2), 1)
    encode = lambda a, b: t.encode(text[a:b], add_special_tokens=False)
    start, end = 0, min(n, chunk)
    cur, begin, total, width = encode(start, end), 0, 0, overlap  # begin: the token of the chunk from which its tokens count
    while end < n:
        right = end - width
        right_end = min(n, right + max(chunk, 2 * width))
        wide = encode(right, right_end)
        found = _splice(cur, start, begin, end, wide, right)
        if found:
            total += found[0] - begin
            cur, begin, start, end, width = wide, found[1], right, right_end, overlap
        else:
            # twice as long each time, so all encodings together are a few times the last
            end, width = min(n, start + 2 * (end - start)), min(2 * width, (end - start) // 2)
            cur = encode(start, end)
    return total + len(cur) - begin


def _pieces(part: tk.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of the pieces of a slice's texts."""
    data = part.data
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[part.bounds] = True
    if len(data) > 2:
        before, two = data[1:-1], data[:-2]
        # ASCII that isn't white space (0x1C to 0x1F count as such for some libraries), or a character from U+00C0 to U+00FF
        sure = ((before > 0x20) & (before < 0x7F)) | ((two == 0xC3) & (before >= 0x80))
        cut[2:-1] |= (data[2:] == 0x20) & sure
    at = np.flatnonzero(cut)
    return at[:-1], at[1:]


def _count_pieces(t, memo: dict[bytes, int], part: tk.Slice, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Tokens of each byte range of a slice, by the library or from ``memo``."""
    kinds, where, back = np.unique(tk.range_hash(part.data, start, end), return_index=True, return_inverse=True)
    size, like = end - start, where[back]
    odd = np.flatnonzero((size != size[like]) | ~tk.same_bytes(part.data, start, start[like], np.minimum(size, size[like])))
    where = np.concatenate([where, odd])  # ranges that only share a hash are counted for themselves
    back[odd] = len(kinds) + np.arange(len(odd))
    raw = part.data.tobytes()
    texts = [raw[a:b] for a, b in zip(start[where].tolist(), end[where].tolist(), strict=True)]
    each = np.array([memo.get(x, -1) for x in texts], dtype=np.int64)
    fresh = np.flatnonzero(each < 0)
    if len(memo) + len(fresh) > MEMO:
        memo.clear()
    for a in range(0, len(fresh), 4096):
        some = fresh[a : a + 4096].tolist()
        for j, e in zip(some, t.encode_batch_fast([texts[j].decode() for j in some], add_special_tokens=False), strict=True):
            each[j] = len(e)
            if len(texts[j]) <= MEMO_BYTES:
                memo[texts[j]] = len(e)
    return each[back]


def _counts(path: str, huge: int, chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, memo = tokenizer(path), _counted.setdefault(path, {})
        for batch in batches:
            size, tokens = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for part in tk.slices(batch.column(1)):
                length = np.diff(part.bounds)
                size[part.first : part.last] = length
                for i in np.flatnonzero(length > huge):
                    text = part.data[part.bounds[i] : part.bounds[i + 1]].tobytes().decode()
                    tokens[part.first + i] = count_huge(t, text, chunk, overlap)
                if not (length[length <= huge] > 0).any():
                    continue
                start, end = _pieces(part)
                text = np.searchsorted(part.bounds, start, side="right") - 1
                keep = length[text] <= huge
                start, end, text = start[keep], end[keep], text[keep]
                each = _count_pieces(t, memo, part, start, end)
                tokens[part.first : part.last] += np.bincount(text, each, minlength=part.last - part.first).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(tokens)], ["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, path: str, limit: int = 512, huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text, as the library counts them with the tokenizer file ``path`` (a byte-level BPE .json).

    Returns a row per row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens (no begin, end or added tokens; special strings
    inside a text are one token, the library's default), over_limit (n_tokens > ``limit``). Null and empty texts count 0.
    Rows that repeat are counted each. Further columns aren't used. ``path`` must be readable on every worker.
    """
    ship(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(_counts(path, huge, chunk, overlap), "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
