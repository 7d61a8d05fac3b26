"""Secret scans with multipart credential linking.

Strong findings stand alone. Weak candidates (account names, opaque tokens, short assigned
values, endpoints) are reported only where complementary parts meet: an interval join of the
candidates' neighbourhoods inside one document, swept in order of position, must bring a
secret together with an identifier or an endpoint. A scope ends with the document, so the join
needs no shuffle and no text leaves its task. The join is two binary searches a candidate: of
the intervals that start early enough, the one that ends last decides.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenia.llm.common import map_batches

#: The strong patterns, their least lengths, and the kinds in order.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST, ACCESS_LEAST = 8, 16
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

#: The weak patterns.
IDENTIFIER = re.compile(r"""\b(?:user(?:name)?|login|account|client_id|access_key_id|key_id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})|\b(?:ASIA|AROA|AIDA)[A-Z0-9]{12,}\b""", re.I | re.A)
ENDPOINT = re.compile(r"""\b(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqp|ftp|s3)://[^\s"'<>]+|\b(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?([A-Za-z0-9.-]+(?::\d+)?)""", re.I | re.A)
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*[0-9])(?=[A-Z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
SHORT = re.compile(r"""\b(?:pwd|pass|passwd|password|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{4,})""", re.I | re.A)
_HINTS = (b"user", b"login", b"account", b"client_id", b"key_id", b"asia", b"aroa", b"aida", b"://", b"host", b"endpoint", b"server")

Span = tuple[str, int, int]


class Intervals:
    """Intervals in order of their starts, each with the latest end up to it."""

    def __init__(self, spans: Iterable[tuple[int, int]]):
        spans = sorted(spans)
        self.starts = [a for a, _ in spans]
        self.ends = list(accumulate((b for _, b in spans), max))

    def meet(self, a: int, b: int) -> bool:
        """Whether one of them starts at ``b`` at the latest and ends at ``a`` at the earliest."""
        i = bisect_right(self.starts, b)
        return i > 0 and self.ends[i - 1] >= a

    def hold(self, a: int, b: int) -> bool:
        """Whether one of them holds all from ``a`` to ``b``."""
        i = bisect_right(self.starts, a)
        return i > 0 and self.ends[i - 1] >= b


def strong_spans(text: str, lowered: bytes) -> list[Span]:
    """Findings that need no company, leftmost and non-overlapping for each kind; ends are exclusive."""
    found: list[Span] = []
    if any(w in lowered for w in _WORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if b"akia" in lowered:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return found


def linked_spans(text: str, lowered: bytes, strong: list[Span], reach: int) -> list[Span]:
    """Weak candidates that lie within ``reach`` code points of a complementary part.

    An identifier or endpoint counts if a secret (strong or weak) is near, a weak secret if an
    identifier or endpoint is near. No candidate overlaps a strong finding, and no weak secret
    lies inside an identifier or endpoint.
    """
    if not any(h in lowered for h in _HINTS) and not any(k == "access" for k, _, _ in strong):
        return []
    taken = Intervals((a, b) for _, a, b in strong)

    def free(a: int, b: int) -> bool:
        return not taken.meet(a + 1, b - 1)

    partners = [("identifier", *m.span()) for m in IDENTIFIER.finditer(text)] + [("endpoint", *m.span()) for m in ENDPOINT.finditer(text)]
    partners = [s for s in partners if free(*s[1:])]
    anchors = [(a, b) for _, a, b in partners] + [(a, b) for k, a, b in strong if k == "access"]
    if not anchors:
        return []
    weak = {m.span() for m in OPAQUE.finditer(text)} | {m.span() for m in SHORT.finditer(text)}
    within = Intervals((a, b) for _, a, b in partners)
    weak = [s for s in weak if free(*s) and not within.hold(*s)]
    known = Intervals(anchors)
    secrets = Intervals([*weak, *[(a, b) for k, a, b in strong if k != "access"]])
    out = [("secret", a, b) for a, b in weak if known.meet(a - reach, b + reach)]
    return out + [p for p in partners if secrets.meet(p[1] - reach, p[2] + reach)]


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 200) -> DataFrame:
    """``doc_id, spans`` for every row: all findings as ``array<struct<kind, start, end, strong>>``.

    Offsets count code points of the whole text; spans are in order of start, then kind. A null
    or empty text has no spans, repeated rows and null ids are scanned each for itself, an empty
    table gives an empty result; other columns are not read.
    """
    rank = {k: i for i, k in enumerate(KINDS)}
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("strong", pa.bool_())]))

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text in batch.column(1).to_pylist():
            text = text or ""
            lowered = text.encode(errors="replace").lower()
            strong = strong_spans(text, lowered)
            rows = [(s, True) for s in strong] + [(s, False) for s in linked_spans(text, lowered, strong, reach)]
            out.append([{"kind": k, "start": a, "end": b, "strong": base} for (k, a, b), base in sorted(rows, key=lambda x: (x[0][1], rank[x[0][0]]))])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["doc_id", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, of, "doc_id long, spans array<struct<kind: string, start: int, end: int, strong: boolean>>")
