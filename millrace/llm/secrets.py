"""Secret scan: fixed formats plus sliding-window Shannon entropy per character class."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64", "entropy_lower", "entropy_base32", "entropy_base62")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LONG_HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")

#: Character class, its alphabet, window length and the entropy in bits that some window must reach. Each class scans what
#: those before it have left of a run; limits of the smaller alphabets lie at about the lowest 1 % of their random windows.
CLASSES = (
    ("entropy_hex", re.compile(r"[0-9A-Fa-f]+"), 20, 3.0),
    ("entropy_base64", re.compile(r"[A-Za-z0-9+/_=-]+"), 20, 3.9),
    ("entropy_lower", re.compile(r"[a-z0-9]+"), 20, 3.4),
    ("entropy_base32", re.compile(r"[A-Z2-7]+"), 20, 3.34),
    ("entropy_base62", re.compile(r"[A-Za-z0-9]+"), 20, 3.64),
)
#: Candidates that match one of these whole are not secrets: words with dashes or underscores, plain numbers,
#: paths of words, UUIDs, ISO dates and times.
ALLOW = (
    r"[A-Za-z]+",
    r"[0-9_-]+",
    r"(?:[A-Za-z]+|[0-9]{1,4})(?:[-_/=+]+(?:[A-Za-z]+|[0-9]{1,4}))*[-_/=+]*",
    r"[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}",
    r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9:]+",
)


def peak_entropy(text: str, window: int) -> float:
    """Largest Shannon entropy in bits over all windows of ``window`` characters.

    Counts are kept as the window moves, and with them S = sum of c*log2(c); entropy is log2(w) - S/w.
    """
    if len(text) < window:
        return 0.0
    part = [0.0] + [c * math.log2(c) for c in range(1, window + 2)]  # a character comes in before one goes out
    counts: dict[str, int] = {}
    total, best = 0.0, math.inf
    for i, char in enumerate(text):
        c = counts.get(char, 0)
        total += part[c + 1] - part[c]
        counts[char] = c + 1
        if i >= window:
            old = text[i - window]
            c = counts[old]
            total += part[c - 1] - part[c]
            counts[old] = c - 1
        if i >= window - 1 and total < best:
            best = total
    return math.log2(window) - best / window


def base_spans(text: str) -> list[tuple[int, int, str]]:
    spans = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return spans + [(m.start(), m.end(), "hex") for m in LONG_HEX.finditer(text)]


class Holders:
    """Answers whether a span lies inside a base span. Those of one kind do not overlap, so only the last that starts
    before it can hold it, and a binary search finds that."""

    def __init__(self, spans: list[tuple[int, int, str]]) -> None:
        kinds = {kind for _, _, kind in spans}
        self.kinds = [[(s, e) for s, e, k in spans if k == kind] for kind in kinds]

    def hold(self, start: int, end: int) -> bool:
        return any((at := bisect_right(kind, (start, math.inf))) and kind[at - 1][1] >= end for kind in self.kinds)


def entropy_spans(text: str, allow: re.Pattern, covered: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Candidate runs whose entropy is high in some window, unless a base span holds them or they are allow-listed."""
    spans, base = [], Holders(covered)
    for run in CANDIDATE.finditer(text):
        if allow.fullmatch(run[0]):
            continue
        left = [run.span()]
        for kind, alphabet, window, least in CLASSES:
            rest = []
            for start, end in left:
                for m in alphabet.finditer(text, start, end):
                    a, b, string = m.start(), m.end(), m[0]
                    if b - a < window or allow.fullmatch(string) or base.hold(a, b):
                        continue
                    if peak_entropy(string, window) >= least:
                        spans.append((a, b, kind))
                        rest.append((start, a))
                        start = b
                rest.append((start, end))
            left = rest
    return spans


def scan(text: str, allow: re.Pattern) -> list[tuple[int, int, str]]:
    """All spans of one text (start, end, kind), by start and then by kind as listed."""
    base = base_spans(text)
    return sorted(base + entropy_spans(text, allow, base), key=lambda s: (s[0], KINDS.index(s[2])))


def find_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allow: tuple[str, ...] = ALLOW
) -> DataFrame:
    """One row per document: ``id_col`` and ``spans``, an array of (kind, start, end) in code points, end exclusive.

    Fixed formats are ``assign``, ``access`` and ``hex``. The entropy method adds runs of 20 or more characters of one
    class (``entropy_hex``, ``entropy_base64``, and smaller alphabets) that have a window of high entropy and are neither inside a fixed
    span nor matched whole by an ``allow`` pattern. Null and empty texts have no spans; null ids and repeated
    rows are scanned like any other; other columns are ignored. Rows are independent, nothing is shuffled.
    """
    allowed = "|".join(f"(?:{p})" for p in allow) or r"(?!)"

    @F.pandas_udf("array<struct<kind:string,start:bigint,end:bigint>>")
    def secret_spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pattern = re.compile(allowed)
        for batch in batches:
            yield pd.Series([[{"kind": k, "start": a, "end": b} for a, b, k in scan(t or "", pattern)] for t in batch], dtype=object)

    return docs.select(id_col, secret_spans(F.col(text_col)).alias("spans"))


def span_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the fixed kinds, the digest of their spans, and all spans as text."""

    def text(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select(
        id_col,
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(text(base).cast("binary"), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
    )
