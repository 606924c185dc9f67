"""Secret scans: listed patterns, and windows of high Shannon entropy.

Listed patterns find assignments, access keys and hexadecimal strings. Beyond
them every maximal run of a character class is a candidate if it is as long as
the class's window. A window slides over it; the counts of its characters are
kept up to date as one enters and one leaves, and with them the entropy. What
windows of enough entropy cover is a span, unless an allow-list knows the
candidate (ordinary words, UUIDs, paths) or a listed pattern holds the span.

Entropy is compared in whole numbers: bits times ENTROPY_UNIT, from a table of
c * log2(c), so that the order of additions can't matter.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTROPY_UNIT = 1_000_000
SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"

#: Fixed values of the contract: patterns and the least lengths of what they find.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 12, 18, 16
#: Lower-case parts, one of which every assignment holds.
ASSIGN_PARTS = ("passw", "secret", "token", "apikey", "api_key")

_assign = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
_access = re.compile(ACCESS)
_hex = re.compile(f"[0-9a-f]{{{HEX_CHARS},}}")  # runs are maximal: shorter ones fail as a whole


@dataclass(frozen=True)
class CharClass:
    """Runs of chars (a character set of re) with windows of window characters that hold least_bits per character."""

    kind: str
    chars: str
    window: int
    least_bits: float

    def table(self) -> list[int]:
        """c * log2(c) for every count c of a character in a window."""
        return [0, *(round(c * math.log2(c) * ENTROPY_UNIT) for c in range(1, self.window + 1))]

    def most(self) -> int:
        """The largest sum of table over a window's characters at which it still has least_bits."""
        return math.floor(self.window * (math.log2(self.window) - self.least_bits) * ENTROPY_UNIT)


CLASSES = (CharClass("entropy_hex", "0-9A-Fa-f", 20, 3.0), CharClass("entropy_base64", "A-Za-z0-9+/_-", 24, 4.0))
#: Candidates that are one of these as a whole are no secrets: words, alone or joined to names and paths, and UUIDs.
ALLOWED = (r"[-_/]*(?:[A-Z]+|[A-Z]?[a-z]+)(?:[-_/]+(?:[A-Z]+|[A-Z]?[a-z]+))*[-_/]*", r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}", r"[-_=+/]+")
#: The order of kinds at one start.
KINDS = ("assign", "access", "hex", *(c.kind for c in CLASSES))


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of what the listed patterns find, code points from 0."""
    found = []
    low = text.lower()
    if any(part in low for part in ASSIGN_PARTS):
        found += [(m.start(), "assign", m.end()) for m in _assign.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in _access.finditer(text) if m.end() - m.start() >= ACCESS_CHARS]
    found += [(m.start(), "hex", m.end()) for m in _hex.finditer(text)]
    return found


def dense_windows(run: str, table: list[int], window: int, most: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the stretches of run that windows with a sum of at most `most` cover; touching ones are one."""
    counts: dict[str, int] = {}
    total, since, until = 0, None, None
    for i, c in enumerate(run):
        if i >= window:
            gone = run[i - window]
            n = counts[gone]
            counts[gone], total = n - 1, total + table[n - 1] - table[n]
        n = counts.get(c, 0)
        counts[c], total = n + 1, total + table[n + 1] - table[n]
        start = i - window + 1
        if start >= 0 and total <= most:
            if until is not None and start > until:
                yield since, until
                since = None
            since, until = start if since is None else since, i + 1
    if since is not None:
        yield since, until


class Scanner:
    """Finds the spans of a text: those of the listed patterns, and those that the classes add."""

    def __init__(self, classes: tuple[CharClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED):
        self.classes = [(c.kind, re.compile(f"[{c.chars}]{{{c.window},}}"), c.table(), c.window, c.most()) for c in classes]
        self.allowed = re.compile("|".join(f"(?:{a})" for a in allowed) or r"(?!)", re.ASCII)
        self.order = {kind: i for i, kind in enumerate(("assign", "access", "hex", *(c.kind for c in classes)))}

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        found = base_spans(text)
        base = sorted((start, end) for start, _, end in found)
        starts, reach = [start for start, _ in base], list(accumulate((end for _, end in base), max))  # how far listed spans up to each one go
        for kind, runs, table, window, most in self.classes:
            for m in runs.finditer(text):
                if self.allowed.fullmatch(m[0]):
                    continue
                for lo, hi in dense_windows(m[0], table, window, most):
                    lo, hi = lo + m.start(), hi + m.start()
                    before = bisect_right(starts, lo)
                    if not before or reach[before - 1] < hi:
                        found.append((lo, kind, hi))
        return [(kind, start, end) for start, kind, end in sorted(found, key=lambda s: (s[0], self.order[s[1]], s[2]))]


def with_spans(docs: DataFrame, text_col: str = "text", out: str = "spans", scanner: Scanner | None = None) -> DataFrame:
    """docs with the spans of every whole text, by start, kind as listed, and end: array of (kind, start, end), in code points, end exclusive.

    A null or empty text has none. Every row is scanned by itself, so repeated
    rows and rows under one id are told alike and each stays. Other columns
    pass through; one named as out is replaced. An empty table gives no rows.
    Nothing is shuffled; a task holds one batch of texts.
    """
    scanner = scanner or Scanner()

    @F.pandas_udf(SPANS)
    def scan(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "start": a, "end": b} for k, a, b in scanner.spans(t)] if t else [] for t in texts], dtype=object)

    return docs.withColumn(out, scan(F.col(f"`{text_col}`")))


def told(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(docs: DataFrame, mask: str = "***") -> DataFrame:
    """docs with text in which every stretch that spans cover is replaced by mask; null texts stay null.

    Overlapping spans are one stretch. Columns and rows stay as they are.
    """
    scanner = Scanner()

    @F.pandas_udf("string")
    def cover(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            if text is None:
                return None
            parts, at = [], 0
            for _, start, end in scanner.spans(text):
                if end > at:
                    parts += [text[at:start], mask] if start >= at else []
                    at = end
            return "".join([*parts, text[at:]])

        return pd.Series([one(t) for t in texts], dtype=object)

    return docs.withColumn("text", cover("text"))


def query(docs: DataFrame) -> DataFrame:
    found = with_spans(docs.select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


def _sql() -> str:
    """op13 for DuckDB: positions from the lengths of matches and of what lies between them; every window counted anew."""
    letters = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in "password")
    either = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
    assign = f"(?:{letters}|{either('passwd')}|{either('secret')}|{either('token')}|{either('api')}_?{either('key')})"
    tail = r"""["'']?\x20*[:=]\x20*["'']?"""
    patterns = [("assign", f"{assign}{tail}[A-Za-z0-9+/_.=-]+"), ("access", "AKIA[A-Z0-9]+"), ("hex", "[0-9a-f]{16,}")]
    patterns += [(c.kind, f"[{c.chars}]{{{c.window},}}") for c in CLASSES]
    found = "\n  UNION ALL ".join(f"SELECT row_no, '{kind}' AS kind, regexp_extract_all(text, '{p}') AS hits, list_transform(string_split_regex(text, '{p}'), lambda g: length(g)) AS gaps FROM d" for kind, p in patterns)
    tables = " ".join(f"WHEN '{c.kind}' THEN {c.table()}" for c in CLASSES)
    sizes = " ".join(f"WHEN '{c.kind}' THEN {c.window}" for c in CLASSES)
    limits = " ".join(f"WHEN '{c.kind}' THEN {c.most()}" for c in CLASSES)
    allowed = "|".join(f"(?:{a})" for a in ALLOWED)
    order = " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(KINDS))
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS row_no FROM documents),
f AS ({found}),
u AS (SELECT row_no, kind, unnest(hits) AS hit, unnest(gaps[1:len(hits)]) AS gap, unnest(range(1, len(hits) + 1)) AS i FROM f WHERE len(hits) > 0),
p AS (SELECT row_no, kind, hit, sum(gap + length(hit)) OVER (PARTITION BY row_no, kind ORDER BY i) - length(hit) AS start FROM u),
base AS (SELECT row_no, kind, start, start + length(hit) AS stop FROM p
  WHERE (kind = 'assign' AND length(regexp_extract(hit, '^{assign}{tail}(.*)$', 1)) >= 12) OR (kind = 'access' AND length(hit) >= 18) OR kind = 'hex'),
w AS (SELECT row_no, kind, hit, start, CASE kind {sizes} END AS size FROM p WHERE kind LIKE 'entropy%' AND NOT regexp_full_match(hit, '{allowed}')),
x AS (SELECT *, unnest(range(0, length(hit) - size + 1)) AS pos FROM w),
c AS (SELECT row_no, kind, size, start, pos, ch, count(*) AS n FROM (SELECT row_no, kind, size, start, pos, unnest(string_split(substr(hit, pos + 1, size), '')) AS ch FROM x) GROUP BY ALL),
h AS (SELECT row_no, kind, size, start, pos FROM c GROUP BY ALL HAVING sum((CASE kind {tables} END)[n + 1]) <= max(CASE kind {limits} END)),
g AS (SELECT *, CASE WHEN pos > lag(pos) OVER o + size THEN 1 ELSE 0 END AS fresh FROM h WINDOW o AS (PARTITION BY row_no, kind, start ORDER BY pos)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY row_no, kind, start ORDER BY pos) AS island FROM g),
m AS (SELECT row_no, kind, start + min(pos) AS start, start + max(pos) + max(size) AS stop FROM s GROUP BY row_no, kind, s.start, island),
a AS (SELECT * FROM base UNION ALL SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.row_no = m.row_no AND b.start <= m.start AND m.stop <= b.stop)),
t AS (SELECT *, CASE kind {order} END AS o, kind || ':' || start::BIGINT || ':' || stop::BIGINT AS says FROM a)
SELECT doc_id, (count(*) FILTER (kind = 'assign'))::BIGINT AS n_assign, (count(*) FILTER (kind = 'access'))::BIGINT AS n_access, (count(*) FILTER (kind = 'hex'))::BIGINT AS n_hex,
  sha256(coalesce(string_agg(says, ',' ORDER BY start, o, stop) FILTER (o < 3), '')) AS base_sha256, coalesce(string_agg(says, ',' ORDER BY start, o, stop), '') AS spans
FROM d LEFT JOIN t USING (row_no) GROUP BY row_no, doc_id
"""


SQL = _sql()
