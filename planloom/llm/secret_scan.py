"""Operator 8: secrets in texts, by fixed patterns and by a battery of randomness tests with false-discovery control.

The patterns give the base spans. Other long tokens become candidates: their encoding is inferred from their characters
and the characters are put in the encoding's order. Three tests ask whether the token can be random: chi-squared
uniformity over the alphabet, runs above and below its middle, and serial correlation of neighbours. Their p-values are
combined. That a token is ordinary text is what is tested: its p-value is 1 where the battery says that it isn't random, and else the chance
that text of the same length would repeat characters as little. So it is at least that chance for every token, and a weighted
Benjamini-Hochberg step over all tokens of the corpus that the battery judged, passed or not, bounds the share of false alarms; the
weights grow with the length, since short tokens can hardly be told from words. The step works on counts of tokens
by p-value, so nothing but a table of fixed size is gathered.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import materialise, ship

KINDS = ("assign", "access", "hex", "random")
PATTERNS = (
    re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    re.compile(r"AKIA[A-Z0-9]+"),
    re.compile(r"[0-9a-f]+"),
)
#: A maximal run of these, of 20 or more, is a candidate, with the padding at its end; '=' elsewhere parts a name from its value.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
#: Parts of a run that no alphabet has as a whole: those between '_' and '-', and those between '/' and '+'.
PARTS = (re.compile(r"[A-Za-z0-9+/]{20,}={0,2}"), re.compile(r"[A-Za-z0-9_-]{20,}={0,2}"))

#: The encodings, from the narrowest, with their alphabets in order.
ENCODINGS = (
    ("hex", "0123456789abcdef"),
    ("hex_upper", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base36_upper", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
_SETS = [(name, set(letters), {c: i for i, c in enumerate(letters)}, len(letters)) for name, letters in ENCODINGS]

#: Share of pairs, and of triples, of letters in ordinary text that are equal.
TEXT_PAIRS, TEXT_TRIPLES = 0.066, 0.0059
#: Share of places at which a new word begins in text of joined words.
TEXT_PIECES = 0.18
#: A token with a smaller combined p-value isn't random.
RANDOM_LEVEL = 0.001
#: The share of false alarms that is borne among the spans that the tests add.
FALSE_SHARE = 0.01
#: Lengths from which weights count: one stratum for each.
STRATA = (20, 24, 32, 40, 64, 128)
#: p-values are counted by tenths of their logarithm, down to this many.
BINS = 400


def infer(token: str) -> tuple[str, np.ndarray, int] | None:
    """The narrowest encoding that has all characters of the token (without '=' at its end), their places, its size."""
    body = token.rstrip("=")
    chars = set(body)
    for name, letters, place, size in _SETS:
        if chars <= letters:
            return name, np.fromiter((place[c] for c in body), dtype=np.int64, count=len(body)), size
    return None


def _normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def chi_squared_p(places: np.ndarray, size: int) -> float:
    """Upper tail of the chi-squared statistic over bins of the alphabet that expect 2 or more each."""
    n = len(places)
    bins = int(max(2, min(size, n // 2, 16)))
    which = places * bins // size
    share = np.bincount(np.arange(size) * bins // size, minlength=bins) / size
    seen = np.bincount(which, minlength=bins)
    x, free = float(((seen - n * share) ** 2 / (n * share)).sum()), bins - 1
    z = ((x / free) ** (1 / 3) - (1 - 2 / (9 * free))) / math.sqrt(2 / (9 * free))
    return _normal_tail(z)


def runs_p(places: np.ndarray, size: int) -> float:
    """Two-sided p-value of the number of runs above and below the alphabet's middle."""
    up = places * 2 >= size
    n, a = len(places), int(up.sum())
    b = n - a
    if not a or not b:
        return 2.0 ** (1 - n)
    mean = 2 * a * b / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    if var <= 0:
        return 1.0
    runs = 1 + int(np.count_nonzero(up[1:] != up[:-1]))
    return 2 * _normal_tail(abs(runs - mean) / math.sqrt(var))


def serial_p(places: np.ndarray) -> float:
    """Two-sided p-value of the correlation between neighbours."""
    n = len(places)
    x = places - places.mean()
    square = float((x * x).sum())
    if square == 0:
        return 0.0
    r = float((x[1:] * x[:-1]).sum()) / square
    return 2 * _normal_tail(abs(r + 1 / n) * math.sqrt(n))


def combine(values: list[float]) -> float:
    """Cauchy combination: valid however the tests depend on each other."""
    t = sum(math.tan((0.5 - min(max(p, 1e-15), 1 - 1e-15)) * math.pi) for p in values) / len(values)
    return min(max(0.5 - math.atan(t) / math.pi, 1e-15), 1.0)


def text_p(body: str) -> float:
    """Chance that ordinary text of this length has as few equal pairs of letters (case aside) and as many words."""
    n = len(body)
    counts: dict[str, int] = {}
    for c in body.lower():
        counts[c] = counts.get(c, 0) + 1
    equal = sum(c * (c - 1) for c in counts.values()) / 2
    pairs = n * (n - 1) / 2
    var = pairs * TEXT_PAIRS * (1 - TEXT_PAIRS) + n * (n - 1) * (n - 2) * max(TEXT_TRIPLES - TEXT_PAIRS**2, 0)
    z = (pairs * TEXT_PAIRS - equal - 0.5) / math.sqrt(var)
    mixed = sum((any(c.isdigit() for c in body), any(c.islower() for c in body), any(c.isupper() for c in body)))
    if mixed >= 2:  # pieces of one kind of characters, with the capital or separator before it, are words in text, and about two characters in random tokens
        kind = np.array([0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3 for c in body])
        new = (kind[1:] != kind[:-1]) & (kind[:-1] != 3) & ~((kind[:-1] == 2) & (kind[1:] == 1))
        rate = TEXT_PIECES
        z = (z + (int(np.count_nonzero(new)) - rate * (n - 1) - 0.5) / math.sqrt(rate * (1 - rate) * (n - 1))) / math.sqrt(2)
    return max(_normal_tail(z), 1e-40)


def stratum(n: int) -> int:
    return sum(n >= x for x in STRATA) - 1


def p_bin(p: float) -> int:
    return min(int(-10 * math.log10(p)), BINS - 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns' matches, in code points, sorted."""
    out = [(m.start(), 0, m.end()) for m in PATTERNS[0].finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in PATTERNS[1].finditer(text) if m.end() - m.start() >= 20]
    # a run of 24 begins where a run begins, so this finds the same runs as the pattern and a check of lengths
    out += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    return sorted(out)


LONG_HEX = re.compile(r"[0-9a-f]{24,}")


def tokens(run: str) -> list[tuple[int, int]]:
    """Where the tokens of a run are: the whole of it, if an alphabet has its characters, and otherwise its PARTS, which may overlap."""
    return [(0, len(run))] if infer(run) else sorted({m.span() for cut in PARTS for m in cut.finditer(run)})


class Taken:
    """Disjoint stretches, in order, that tell in logarithmic time whether another one overlaps them."""

    def __init__(self, spans=()):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, a: int, b: int) -> bool:
        i = bisect_left(self.starts, b) - 1
        return i >= 0 and self.ends[i] > a

    def add(self, a: int, b: int) -> None:
        i = bisect_left(self.starts, a)
        self.starts.insert(i, a)
        self.ends.insert(i, b)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(start, end, stratum, p-value bin) of tokens outside the base spans that the randomness battery judged.

    Of tokens that overlap the one least like text stands, its p-value times the number of the run's tokens. Where none of a run
    passes, the run's longest token stands with a p-value of 1.
    """
    out, known = [], Taken((s, e) for s, _, e in base)
    for m in CANDIDATE.finditer(text):
        at, passed, kept, judged = tokens(m[0]), [], [], None
        for i, j in at:
            a, b = m.start() + i, m.start() + j
            if known.meets(a, b):
                continue
            _, places, size = infer(text[a:b])
            if len(places) < 20:
                continue
            if combine([chi_squared_p(places, size), runs_p(places, size), serial_p(places)]) >= RANDOM_LEVEL:
                passed.append((min(len(at) * text_p(text[a:b].rstrip("=")), 1.0), a, b))
            elif judged is None or b - a > judged[1] - judged[0]:
                judged = a, b
        own = Taken()
        for p, a, b in sorted(passed):
            if not own.meets(a, b):
                own.add(a, b)
                kept.append((a, b, stratum(b - a), p_bin(p)))
        if judged and not passed:
            kept.append((*judged, stratum(judged[1] - judged[0]), 0))
        out += sorted(kept)
    return out


_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
_CANDIDATE = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("stratum", pa.int32()), ("bin", pa.int32())])
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("base", pa.list_(_SPAN)), ("base_sha256", pa.string()), ("candidates", pa.list_(_CANDIDATE))])
_DDL = "doc_id long, base array<struct<start:long,kind:int,end:long>>, base_sha256 string, candidates array<struct<start:long,end:long,stratum:int,bin:int>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for ident, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py() or ""
            base = base_spans(text)
            said = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base)
            rows.append({
                "doc_id": ident, "base": [{"start": s, "kind": k, "end": e} for s, k, e in base], "base_sha256": hashlib.sha256(said.encode()).hexdigest(),
                "candidates": [{"start": a, "end": b, "stratum": c, "bin": d} for a, b, c, d in candidates(text, base)],
            })
        yield pa.RecordBatch.from_pylist(rows, _SCHEMA)


def thresholds(counts: dict[tuple[int, int], int], share: float = FALSE_SHARE) -> dict[int, int]:
    """The least p-value bin that is accepted, by stratum: Benjamini-Hochberg on p / weight over all candidates.

    Weights are proportional to the strata's lengths and have a mean of 1 over the candidates. A bin's upper end stands
    for its p-values, which errs on the safe side.
    """
    total = sum(counts.values())
    if not total:
        return {}
    mean = sum(STRATA[s] * n for (s, _), n in counts.items()) / total
    weight = {s: STRATA[s] / mean for s in range(len(STRATA))}
    scaled = sorted((10 ** (-b / 10) / weight[s], s, b, n) for (s, b), n in counts.items())
    taken, cut = 0, 0.0
    for i, (p, _, _, n) in enumerate(scaled):
        taken += n
        if (i + 1 == len(scaled) or scaled[i + 1][0] > p) and p <= share * taken / total:
            cut = p
    least: dict[int, int] = {}
    for p, s, b, _ in scaled:
        if p <= cut:
            least[s] = min(least.get(s, BINS), b)
    return least


def scan_secrets(docs: DataFrame, share: float = FALSE_SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of secrets in every whole text: a row per row of ``docs``.

    Returns doc_id, base (array of start, kind, end of the fixed patterns, in code points, end exclusive), base_sha256, and
    added (the spans of the randomness tests at a false-discovery share of ``share`` over all rows). Null and empty texts have
    no spans; rows that repeat are scanned each; further columns aren't used; an empty table gives an empty result. Very long texts
    are scanned whole, in time that grows with their length.
    """
    ship(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = materialise(texts.mapInArrow(_scan, _DDL), "secrets")
    # at most strata * bins rows, whatever the corpus holds
    counted = found.select(F.explode("candidates").alias("c")).groupBy("c.stratum", "c.bin").agg(F.count("*").alias("n")).collect()
    least = thresholds({(r["stratum"], r["bin"]): r["n"] for r in counted}, share)
    cuts = F.array(*[F.lit(least.get(s, BINS + 1)) for s in range(len(STRATA))])
    good = F.filter("candidates", lambda c: c["bin"] >= F.get(cuts, c["stratum"]))
    return found.select("doc_id", "base", "base_sha256", F.transform(good, lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end"))).alias("added"))


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, counts by pattern, base_sha256 and all spans as kind:start:end, by start and kind, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    every = F.array_sort(F.concat("base", "added"))
    spans = F.array_join(F.transform(every, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return scanned.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), "base_sha256", spans.alias("spans"))
