"""Secret scans: fixed patterns, and sliding-window entropy over candidate strings.

*Base.*  Three patterns, leftmost and non-overlapping per kind: ``assign`` (a credential-like name set
to a value of 12 or more characters), ``access`` (``AKIA`` keys of 18 or more) and ``hex`` (runs of 16
or more).  Matches that are too short are dropped after matching, so they still consume their text.

*Entropy.*  Candidates are runs of ``[A-Za-z0-9+/_=-]`` of at least ``WINDOW`` characters.  A window
slides over each candidate; its Shannon entropy per character class is kept up to date from counts
(one character enters, one leaves: with S = sum of c*log2(c), H = log2(W) - S/W).  A window
counts where its characters are all of a class and H reaches that class's limit.  Classes: ``hex``
(0-9a-f or 0-9A-F), ``lower36`` (a-z0-9), ``upper36`` (A-Z0-9) and ``mixed`` (all of the alphabet,
needing a digit and letters of both cases).  Touching windows merge into one span of kind ``entropy``.

*Allow-list.*  Candidates that are known to be harmless give no entropy span: plain words (letters only),
numbers, runs with one repeated unit, UUIDs, dates and versions, paths of plain words.  Placeholders
(``example``, ``xxxx``, ``changeme``, ...) are cut out of a candidate, and each piece between them is
held against the list and scanned by itself, so a key beside a placeholder is found.  An entropy span
inside a base span is not repeated.  The allow-list never removes a base span.

Offsets are code points, ends exclusive.  Rows: null text is empty and has no spans; every row gives
one row; repeated rows give equal rows; other columns are not read.  Work per text is linear.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import arrow_map, text_or_empty

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # the runs of [0-9a-f]+ that are long enough

WINDOW = 20
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}")
LIMITS = {"hex": 3.0, "lower36": 3.5, "upper36": 3.5, "mixed": 3.7}
_C_LOG_C = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 1)]

ALLOWED = [re.compile(p) for p in (
    r"[A-Za-z]+\Z",                                        # a word
    r"[-_=+/]*[0-9]+([-_=+/][0-9]+)*[-_=+/]*\Z",           # a number, date or rule
    r"(?:[A-Za-z]+[-_/=+]+)+[A-Za-z]*[0-9]{0,4}\Z",        # words joined by signs, a path, a slug
    r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\Z",
    r"(.{1,4}?)\1+.{0,3}\Z",                               # one unit over and over
)]
PLACEHOLDERS = ("example", "changeme", "placeholder", "xxxx", "0123456789", "1234567890", "abcdefgh", "your_", "dummy")
PLACEHOLDER = re.compile("|".join(PLACEHOLDERS), re.IGNORECASE | re.ASCII)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns."""
    out = []
    lowered = text.lower()
    if any(name in lowered for name in _NAMES):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def allowed(candidate: str) -> bool:
    return any(p.match(candidate) for p in ALLOWED)


def pieces(candidate: str) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a candidate, at least a window long, that its placeholders leave."""
    out, at = [], 0
    for m in PLACEHOLDER.finditer(candidate):
        out.append((at, m.start()))
        at = m.end()
    return [(a, b) for a, b in [*out, (at, len(candidate))] if b - a >= WINDOW]


def dense_windows(s: str) -> list[tuple[int, int]]:
    """Merged (start, end) of the windows of ``s`` whose class entropy reaches its limit."""
    counts: dict[str, int] = {}
    total = 0.0  # sum of c * log2(c) over the window
    kinds = {"digit": 0, "af": 0, "AF": 0, "lower": 0, "upper": 0, "sign": 0}

    def kind(c: str) -> str:
        if c.isdigit():
            return "digit"
        if c.islower():
            return "af" if c <= "f" else "lower"
        if c.isupper():
            return "AF" if c <= "F" else "upper"
        return "sign"

    spans: list[tuple[int, int]] = []
    for i, c in enumerate(s):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += _C_LOG_C[n + 1] - _C_LOG_C[n]
        kinds[kind(c)] += 1
        if i >= WINDOW:
            gone = s[i - WINDOW]
            n = counts[gone]
            counts[gone] = n - 1
            total += _C_LOG_C[n - 1] - _C_LOG_C[n]
            kinds[kind(gone)] -= 1
        if i < WINDOW - 1 or not kinds["digit"]:
            continue
        letters, capitals = kinds["af"] + kinds["lower"], kinds["AF"] + kinds["upper"]
        if not kinds["sign"] and not kinds["lower"] and not kinds["upper"] and not (letters and capitals):
            limit = LIMITS["hex"]
        elif not kinds["sign"] and not capitals:
            limit = LIMITS["lower36"]
        elif not kinds["sign"] and not letters:
            limit = LIMITS["upper36"]
        elif letters and capitals:
            limit = LIMITS["mixed"]
        else:
            continue
        if math.log2(WINDOW) - total / WINDOW >= limit:
            start = i - WINDOW + 1
            if spans and spans[-1][1] >= start:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((start, i + 1))
    return spans


def entropy_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    out = []
    starts = [start for start, _, _ in base]
    reach = list(accumulate((end for _, _, end in base), max))  # the furthest end of the base spans so far
    for m in CANDIDATE.finditer(text):
        s = m[0]
        if s.isalpha() or allowed(s):
            continue
        for first, last in pieces(s):
            piece = s[first:last]
            if len(piece) < len(s) and allowed(piece.lstrip("+/_=-")):
                continue
            for a, b in dense_windows(piece):
                a, b = a + m.start() + first, b + m.start() + first
                before = bisect_right(starts, a)
                if not before or reach[before - 1] < b:
                    out.append((a, 3, b))
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    base = base_spans(text)
    return base, entropy_spans(text, base)


def secret_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy for every row."""
    def run(batch: pa.RecordBatch) -> dict:
        found = [scan(t.as_py()) for t in batch.column(1)]
        n = [[sum(k == kind for _, k, _ in base) for base, _ in found] for kind in range(3)]
        return {"doc_id": batch.column(0), "n_assign": n[0], "n_access": n[1], "n_hex": n[2],
                "base_sha256": [hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in found],
                "spans": [_joined(base + more) for base, more in found],
                "n_entropy": [len(more) for _, more in found]}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return arrow_map(rows, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
                           "n_entropy long", run)
