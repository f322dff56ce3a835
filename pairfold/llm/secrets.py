"""Secret scans: spans of credentials, and weak candidates linked to their complementary parts.

Strong patterns (assignments, access keys, long hex runs) are reported wherever they stand. Weak candidates (names of
accounts, endpoints, random-looking tokens) are far too common to report alone. They are parts of a credential: an
identifier, a secret or an endpoint. Within a scope (the part's own line, the lines around it, at most ``reach`` code
points away) an interval join links secrets with identifiers and endpoints, and a weak part is reported only when a
complementary part shares its scope. Each pattern is searched once over a text, and the join walks sorted interval ends with
binary search, so a document with many parts costs n log n, and never lists pairs.

Defined results: a null text counts as empty and has no spans; repeated rows are scanned one by one; other columns of
the input are ignored by ``scan_secrets`` and kept by ``redact_secrets``; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
NAME = re.compile(r"""\b(?:client_?id|access_?key_?id|account_?id|user(?:name)?|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}""", re.I | re.A)
ENDPOINT = re.compile(r"""\b[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\s"'<>]{3,}""", re.A)
WEAK = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+={0,2}+(?![A-Za-z0-9+/_=-])")
KINDS = ("assign", "access", "hex", "identifier", "endpoint", "weak")
SPAN = "array<struct<kind:string,start:int,end:int>>"


def random_looking(token: str) -> bool:
    """Digits with both cases of letters, and at least 3.5 bits a character."""
    if not (re.search("[0-9]", token) and re.search("[A-Z]", token) and re.search("[a-z]", token)):
        return False
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in Counter(token).values()) >= 3.5


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Strong spans, leftmost and non-overlapping within each kind."""
    found = []
    if ":" in text or "=" in text:
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return found


class Intervals:
    """Disjoint or nested intervals that answer: does any, but the asking one, meet [lo, hi)?"""

    def __init__(self, spans: list[tuple[int, int]]):
        self.spans = sorted(set(spans))
        self.starts = [s for s, _ in self.spans]
        self.reach, far = [], -1
        for _, e in self.spans:
            far = max(far, e)
            self.reach.append(far)

    def meets(self, lo: int, hi: int) -> bool:
        at = bisect_left(self.starts, hi) - 1
        return at >= 0 and self.reach[at] > lo


def scope_of(text: str, start: int, end: int, reach: int) -> tuple[int, int]:
    """The line of a span with the lines before and after, at most ``reach`` code points away."""
    lo, hi = max(0, start - reach), min(len(text), end + reach)
    at = text.rfind("\n", lo, start)
    if at >= 0 and (before := text.rfind("\n", lo, at)) >= 0:
        lo = before + 1
    at = text.find("\n", end, hi)
    if at >= 0 and (after := text.find("\n", at + 1, hi)) >= 0:
        hi = after
    return lo, hi


def linked_spans(text: str, base: list[tuple[str, int, int]], reach: int = 240) -> list[tuple[str, int, int]]:
    """Weak parts whose scope holds a complementary part."""
    names = [m.span() for m in NAME.finditer(text)] if ":" in text or "=" in text else []
    points = [m.span() for m in ENDPOINT.finditer(text)] if "://" in text else []
    access = [(s, e) for k, s, e in base if k == "access"]
    if not (names or points or access):
        return []
    strong = [(s, e) for k, s, e in base if k == "assign" or k == "hex" and e - s >= 32]
    taken = Intervals([(s, e) for _, s, e in base] + points + names)
    weak = [m.span() for m in WEAK.finditer(text) if not taken.meets(*m.span()) and random_looking(m[0])]
    keys, ids = Intervals(strong + weak), Intervals(names + points + access)
    out = [("identifier", s, e) for s, e in names if keys.meets(*scope_of(text, s, e, reach))]
    out += [("endpoint", s, e) for s, e in points if keys.meets(*scope_of(text, s, e, reach))]
    out += [("weak", s, e) for s, e in weak if ids.meets(*scope_of(text, s, e, reach))]
    return out


def scan_text(text: str | None, reach: int = 240) -> list[tuple[str, int, int]]:
    """All spans of a text by start, then kind; offsets count code points and ends are exclusive."""
    if not text:
        return []
    base = base_spans(text)
    return sorted(base + linked_spans(text, base, reach), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 240) -> DataFrame:
    """A row for each input row: ``doc_id`` and ``spans``, an array of (kind, start, end)."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in text_slices(batches, 1, 1 << 20):
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in scan_text(t.as_py(), reach)] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, span)], names=["doc_id", "spans"])

    return rows.mapInArrow(run, f"doc_id {kind}, spans {SPAN}")


def redact(text: str | None, mask: str, reach: int = 240) -> str | None:
    """The text with each union of overlapping spans replaced by ``mask``."""
    out, at = [], 0
    for _, s, e in scan_text(text, reach):
        if s >= at:
            out += [text[at:s], mask]
        at = max(at, e)
    return text if not at else "".join([*out, text[at:]])


def redact_secrets(df: DataFrame, text_col: str = "text", mask: str = "[SECRET]", reach: int = 240) -> DataFrame:
    """All rows and columns of ``df``, with secrets masked in ``text_col``."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, at, 1 << 20):
            cols = list(b.columns)
            cols[at] = pa.array([redact(t.as_py(), mask, reach) for t in b.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    return df.mapInArrow(run, df.schema)


def digest(scanned: DataFrame) -> DataFrame:
    """Counts, a hash of the base spans and the spans as text, for each scanned row."""
    n = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    said = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("spans", lambda x: x["kind"].isin("assign", "access", "hex"))
    return scanned.select(
        "doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
        F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"),
    )
