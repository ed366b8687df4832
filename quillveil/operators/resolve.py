"""Propagation, merging, numbering and splicing of each document's spans, in Arrow batches.

The patterns' cuts come from the JVM; running sums over them, and everything that depends on the span before, is
one linear pass here.  The same rules as the column expressions in `merge` and `redact`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa

OUT_SPANS = "array<struct<category:string,start:int,end:int,value:string,confidence:double,validator_passed:boolean,needs_review:boolean,placeholder:string>>"
OUT = f"redacted_text string, pii_count int, needs_review boolean, spans {OUT_SPANS}"
_FIELDS = [
    ("category", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("confidence", pa.float64()),
    ("validator_passed", pa.bool_()), ("needs_review", pa.bool_()), ("placeholder", pa.string()),
]


class Span(NamedTuple):
    category: str
    start: int
    end: int
    value: str | None
    confidence: float
    validator_passed: bool | None
    needs_review: bool

    @property
    def size(self) -> int:
        return self.end - self.start


def hits_of(columns: list[pa.Array], names: list[str], rows: int) -> list[list[tuple]]:
    """For each row (category, start, end, ok) of the hits, by pattern, then place; columns hold the patterns' cuts."""
    out: list[list[tuple]] = [[] for _ in range(rows)]
    for name, column in zip(names, columns):
        offsets, cut = np.asarray(column.offsets), column.flatten()
        if not len(cut):
            continue
        sizes = np.diff(offsets)
        sizes = np.where(np.asarray(column.is_valid()), sizes, 0)
        row = np.repeat(np.arange(rows), sizes)
        size, n = (cut.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("size", "n"))
        ends = np.cumsum(size)
        first = np.r_[0, np.cumsum(sizes)[:-1]]
        start = ends - size
        start -= start[np.minimum(first, len(start) - 1)][row]
        keep = np.flatnonzero((n >= 0) & ~cut.field("drop").to_numpy(zero_copy_only=False))
        ok = cut.field("ok").to_pylist() if cut.field("ok").null_count < len(cut) else None
        for k, r, a, b in zip(keep.tolist(), row[keep].tolist(), start[keep].tolist(), (start[keep] + n[keep]).tolist()):
            out[r].append((name, a, b, ok[k] if ok else None))
    return out


def spans_of(text: str, hits: list[tuple]) -> list[Span]:
    """Fail closed: a hit whose check failed stays, at half confidence and for review."""
    return [Span(c, a, b, text[a:b], 0.5 if ok is False else 1.0, ok, ok is False) for c, a, b, ok in hits]


def propagate(text: str, spans: list[Span], chunk: tuple[int, int] | None = None) -> list[Span]:
    """The spans and, behind them, every place of each value found, none overlapping another of the value.

    chunk: (size, overlap) of the windows that a text is read in; a value counts from the beginning of the
    first window that holds it whole.  Without it, or in texts of one window, it counts from the text's beginning.
    """
    first: dict[tuple[str, str], tuple[int, Span]] = {}
    for s in spans:
        at = 0
        if chunk and len(text) > chunk[0]:
            step = chunk[0] - chunk[1]
            at = max(0, -(-(s.end - chunk[0]) // step)) * step
            if at > s.start:  # across the windows' bounds
                continue
        if s.value and ((s.category, s.value) not in first or at < first[s.category, s.value][0]):
            first[s.category, s.value] = (at, s)
    out = list(spans)
    for at, s in first.values():
        n = len(s.value)
        at = text.find(s.value, at)
        while at >= 0:
            out.append(s._replace(start=at, end=at + n))
            at = text.find(s.value, at + n)
    return out


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s.start, s.start - s.end))


def union(spans: list[Span]) -> list[Span]:
    """Disjoint spans that cover all given ones; see `merge.union_merge`."""
    out: list[Span] = []
    for s in in_order(spans):
        if not out or s.start >= out[-1].end:
            out.append(s)
            continue
        last = out[-1]
        takes = s.size > last.size or s.size == last.size and bool(s.validator_passed) and not last.validator_passed
        keep, other = (s, last) if takes else (last, s)
        end = max(last.end, s.end)
        if last.start < keep.start or end > keep.end:
            keep = keep._replace(start=last.start, end=end, value=None, needs_review=keep.needs_review or other.needs_review)
        out[-1] = keep
    return out


# How specific categories are where spans share a range (all others 0), and which are regulated or generic.
SPECIFIC = {
    "username": 100, "tfn": 100, "abn": 100, "acn": 100, "medicare": 100, "healthcare_identifier": 100, "medical_record_number": 100,
    "passport": 90, "driver_licence": 90, "centrelink_crn": 90, "bsb_account": 80, "address": 60, "organisation": 55, "location": 55, "name": 50, "generic_id": 10,
}
REGULATED = {"tfn", "abn", "acn", "medicare", "bsb_account", "passport", "driver_licence", "centrelink_crn", "healthcare_identifier", "medical_record_number"}
GENERIC = {"generic_id", "name", "username"}


def one_of_each(spans: list[Span]) -> list[Span]:
    """Repeats of a (range, category) as one span: any need of review, the first definite verdict, at the lower of the two confidences."""
    def key(s: Span) -> tuple:
        return s.start, s.start - s.end, s.category

    order = {k: i for i, k in reversed(list(enumerate(map(key, spans))))}
    out = []
    for k, same in groupby(sorted(spans, key=key), key):
        first, *more = same
        verdict = next((s for s in (first, *more) if s.validator_passed is not None), first)
        one = first._replace(needs_review=any(s.needs_review for s in (first, *more)), validator_passed=verdict.validator_passed, confidence=min(first.confidence, verdict.confidence))
        out.append((order[k], one))
    return [s for _, s in sorted(out)]


def claim(text: str, s: Span, other: Span) -> tuple:
    """What a span has to say for itself against one it overlaps; the greater claim wins.

    On one range: a passed check, a regulated category, the more specific category.  Else: a passed check of a regulated category
    against a generic span that holds no letter or digit beyond it; the length; a passed check.
    """
    passed, regulated = s.validator_passed is True, s.category in REGULATED
    if (s.start, s.end) == (other.start, other.end):
        return passed, regulated, SPECIFIC.get(s.category, 0)
    beyond = text[other.start : max(other.start, s.start)] + text[min(other.end, s.end) : other.end]
    return passed and regulated and other.category in GENERIC and not any(map(str.isalnum, beyond)), s.size, passed


def by_priority(text: str, spans: list[Span], keep_cover: bool = False) -> list[Span]:
    """Disjoint spans in which regulated identifiers win over generic ones; of two that overlap the one of the greater `claim` stays, the earlier if equal.

    Winners keep their own bounds, so what the loser covered beyond them stays in the text; keep_cover widens them
    instead (and clears their value).  A loser's need of review passes on, unless both share one range.
    """
    def settle(out: list[Span], s: Span) -> list[Span]:
        last = out[-1] if out else None
        if last is None or s.start >= last.end:
            return [*out[:-1], last, s] if last else [s]
        wins = s if claim(text, s, last) > claim(text, last, s) else last
        if (s.start, s.end) != (last.start, last.end):
            wins = wins._replace(needs_review=s.needs_review or last.needs_review)
            if keep_cover and (wins.start, wins.end) != (last.start, max(s.end, last.end)):
                wins = wins._replace(start=last.start, end=max(s.end, last.end), value=None)
        return [*out[:-1], wins]

    # spans that don't touch are settled apart, so each list stays short
    islands, reach = [], -1
    for s in in_order(one_of_each(spans)):
        if s.start >= reach:
            islands.append([])
        islands[-1].append(s)
        reach = max(reach, s.end)
    return [s for island in islands for s in reduce(settle, island, [])]


def placeholders(spans: list[Span], style: str) -> list[str]:
    if style == "asterisk":
        return ["*" * s.size for s in spans]
    numbers: dict[tuple[str, str], int] = {}
    counts: dict[str, int] = {}
    out = []
    for s in spans:
        name = s.category.upper()
        if style == "category" or s.value is None:
            out.append(f"[REDACTED_{name}]")
            continue
        key = (s.category, s.value)
        if key not in numbers:
            numbers[key] = counts[s.category] = counts.get(s.category, 0) + 1
        out.append(f"[REDACTED_{name}_{numbers[key]:03d}]")
    return out


def splice(text: str, spans: list[Span], shown: list[str]) -> str:
    parts, at = [], 0
    for s, p in zip(spans, shown):
        parts += [text[at : s.start], p]
        at = s.end
    return "".join([*parts, text[at:]])


def span_lists(rows: list[list[tuple]]) -> pa.Array:
    """Rows of span tuples (fields as in OUT_SPANS) as an Arrow list of structs."""
    flat = [s for r in rows for s in r]
    columns = [pa.array(c, t) for c, (_, t) in zip(zip(*flat) if flat else [[]] * len(_FIELDS), _FIELDS)]
    items = pa.StructArray.from_arrays(columns, [n for n, _ in _FIELDS])
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(r) for r in rows])].astype(np.int32)), items)


def resolver(
    names: list[str], style: str, chunk: tuple[int, int] | None, propagation: bool, keep_values: bool, merged: Callable[[str, list[Span]], list[Span]], texts: bool = True,
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow over (id, text, cuts of each pattern)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            redacted, review, every = [], [], []
            own = batch.column(1).to_pylist()
            for text, hits in zip(own, hits_of(batch.columns[2:], names, batch.num_rows)):
                spans = spans_of(text, hits)
                if propagation and spans:
                    spans = propagate(text, spans, chunk)
                spans = merged(text, spans)
                shown = placeholders(spans, style)
                redacted.append(splice(text, spans, shown) if texts else None)
                review.append(any(s.needs_review for s in spans))
                every.append([(*(s if keep_values else s._replace(value=None)), p) for s, p in zip(spans, shown)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(redacted, pa.string()), pa.array([len(s) for s in every], pa.int32()), pa.array(review, pa.bool_()), span_lists(every)],
                ["document_id", "redacted_text", "pii_count", "needs_review", "spans"],
            )

    return run
