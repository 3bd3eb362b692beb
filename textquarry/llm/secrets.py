"""Secret scans: three fixed patterns, and windows of high entropy per character class.

A candidate is a run of at least ``window`` characters out of ``[A-Za-z0-9+/_=-]``. A window of fixed length slides over
it; the counts of its characters change by one out and one in a step, so the Shannon entropy costs O(1) a step. The
threshold depends on the narrowest character class that holds the whole candidate. Its parts between delimiters are judged
once more by classes of their own, so a key before a secret doesn't raise its threshold. What the fixed patterns hold is
left out of a candidate beforehand; the rest is judged. Windows that pass are merged.

Defined results: null text counts as empty; a text without findings has an empty array; equal texts give equal spans;
other columns pass through, one of the result's own name is replaced. No text is cut, so memory is that of one batch.
"""
from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, spans_string, table

# The base patterns and their least lengths.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST, ACCESS_LEAST = 8, 16
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
#: Character classes from narrow to wide, each with the bits a window must reach.
CLASSES = (
    ("hex", re.compile(r"[0-9A-Fa-f]+"), 3.0),
    ("lower", re.compile(r"[0-9a-z]+"), 3.6),
    ("upper", re.compile(r"[0-9A-Z]+"), 3.6),
    ("alnum", re.compile(r"[0-9A-Za-z]+"), 3.75),
    ("base64", re.compile(r"[A-Za-z0-9+/_=-]+"), 3.9),
)
#: Whole candidates that are known not to be secrets.
ALLOW = (
    re.compile(r"[A-Za-z_/+=-]+"),  # no digit: words, paths and rules
    re.compile(r"[0-9_/+=-]+"),  # no letter: numbers, dates and rules
    re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}"),  # UUID
    re.compile(r"(?:[A-Za-z]{2,}[-_/]|[0-9]{1,4}[-_/])*(?:[A-Za-z]{2,}|[0-9]{1,4})"),  # slugs and paths
)
#: What parts a candidate.
PART = re.compile(r"[A-Za-z0-9]+")
SPANS = "array<struct<kind:string,start:int,end:int>>"


def windows(text: str, start: int, end: int, bits: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """Merged spans of the windows of text[start:end] whose entropy reaches ``bits``."""
    cost = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    most = window * (math.log2(window) - bits) + 1e-9  # entropy = log2(window) - sum(c log2 c) / window
    counts: dict[str, int] = {}
    total, found = 0.0, []
    for at in range(start, end):
        c = counts.get(text[at], 0)
        counts[text[at]] = c + 1
        total += cost[c + 1] - cost[c]
        first = at - window + 1
        if first < start:
            continue
        if first > start:
            gone = text[first - 1]
            c = counts[gone]
            counts[gone] = c - 1
            total += cost[c - 1] - cost[c]
        if total <= most:
            if found and found[-1][1] >= first:
                found[-1][1] = at + 1
            else:
                found.append([first, at + 1])
    return [tuple(x) for x in found]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind as a place in KINDS, end) of the three patterns, in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def outside(start: int, end: int, spans: list[tuple[int, int]], starts: list[int], reach: list[int]) -> Iterator[tuple[int, int]]:
    """What ``spans``, in order of their starts, leave of a range; reach: the furthest end up to each of them."""
    for s, e in spans[bisect_right(reach, start) : bisect_left(starts, end)]:
        if e > start:
            if s > start:
                yield start, s
            start = max(start, e)
    if start < end:
        yield start, end


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans as one."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def scan(text: str | None, window: int = WINDOW, allow: tuple[re.Pattern, ...] = ALLOW) -> list[dict]:
    """All spans of a text, by start and kind; entropy spans keep clear of the patterns' spans."""
    if not text:
        return []
    found = base_spans(text)
    base = [(s, e) for s, _, e in found]
    starts, reach = [s for s, _ in base], list(accumulate((e for _, e in base), max))
    own = lambda run: next(b for _, c, b in CLASSES if c.fullmatch(run))
    candidate = re.compile(rf"[A-Za-z0-9+/_=-]{{{window},}}")
    for m in candidate.finditer(text):
        if any(a.fullmatch(m[0]) for a in allow):
            continue
        bits, hits = own(m[0]), []
        for start, end in outside(m.start(), m.end(), base, starts, reach):
            hits += windows(text, start, end, bits, window)
            for part in PART.finditer(text, start, end):
                if part.end() - part.start() >= window and not any(a.fullmatch(part[0]) for a in allow):
                    hits += windows(text, part.start(), part.end(), own(part[0]), window)
        found += [(s, 3, e) for s, e in merged(hits)]
    return [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in sorted(found)]


def scan_secrets(docs: DataFrame, text_col: str = "text", out_col: str = "secrets", window: int = WINDOW) -> DataFrame:
    """``docs`` with the array ``out_col`` of the spans found, in code points, end exclusive."""

    bounded_batches(docs.sparkSession)

    @F.pandas_udf(SPANS)
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([scan(t, window) for t in batch], dtype=object)

    return docs.withColumn(out_col, spans(F.col(text_col)))


def op3_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "secrets")
    of = lambda kind: F.filter("secrets", lambda s: s["kind"] == kind)
    base = F.filter("secrets", lambda s: s["kind"] != "entropy")
    return found.select(
        "doc_id",
        *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(spans_string(base), 256).alias("base_sha256"),
        spans_string(F.col("secrets")).alias("spans"),
    )
