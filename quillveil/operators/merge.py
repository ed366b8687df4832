"""Merging of overlapping spans: ordered folds over a document's array of spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.spans import SPAN


def _empty() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def distinct_spans(spans: Column) -> Column:
    """The first span of each (start, end, category), in the order given."""
    def step(acc: Column, s: Column) -> Column:
        known = F.exists(acc, lambda a: (a["start"] == s["start"]) & (a["end"] == s["end"]) & (a["category"] == s["category"]))
        return F.when(known, acc).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(spans, _empty(), step)


def in_order(spans: Column) -> Column:
    """By start, longer first, then as given."""
    keyed = F.transform(spans, lambda s, i: F.struct(s["start"].alias("k0"), (s["start"] - s["end"]).alias("k1"), i.alias("k2"), s.alias("span")))
    return F.transform(F.array_sort(keyed), lambda k: k["span"])


def _last(acc: Column) -> Column:
    return F.element_at(acc, -1)


def union_merge(spans: Column) -> Column:
    """Disjoint spans whose bounds cover all that overlap.

    Of two that overlap the longer stays (the validated one if equal), compared with the
    already widened bounds; where the bounds grow beyond it, its value is cleared and
    the other's need of review is taken over.
    """

    def step(acc: Column, s: Column) -> Column:
        last = _last(acc)
        apart = (F.size(acc) == 0) | (s["start"] >= last["end"])
        size_s, size_l = s["end"] - s["start"], last["end"] - last["start"]
        new = (size_s > size_l) | ((size_s == size_l) & F.coalesce(s["validator_passed"], F.lit(False)) & ~F.coalesce(last["validator_passed"], F.lit(False)))
        start, end = F.least(last["start"], s["start"]), F.greatest(last["end"], s["end"])

        def pick(name: str) -> Column:
            return F.when(new, s[name]).otherwise(last[name])

        grew = (start < pick("start")) | (end > pick("end"))
        kept = F.struct(
            pick("category").alias("category"), start.alias("start"), end.alias("end"), F.when(~grew, pick("value")).alias("value"), pick("confidence").alias("confidence"),
            pick("validator_passed").alias("validator_passed"), F.when(grew, s["needs_review"] | last["needs_review"]).otherwise(pick("needs_review")).alias("needs_review"), pick("seq").alias("seq"),
        )
        return F.when(apart, F.concat(acc, F.array(s))).otherwise(F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(kept)))

    # a span that comes twice changes nothing the second time, so repeats needn't be taken out before
    return F.aggregate(in_order(spans), _empty(), step)


def greedy(spans: Column) -> Column:
    """Spans in order, each that begins before the last kept one ends left out."""
    return F.aggregate(in_order(spans), _empty(), lambda acc, s: F.when((F.size(acc) == 0) | (s["start"] >= _last(acc)["end"]), F.concat(acc, F.array(s))).otherwise(acc))


def overlapping(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def without_overlap(found: Column, existing: Column, override: dict[str, list[str]] | None = None, only: list[str] | None = None) -> Column:
    """Spans of found that overlap none of existing (of the categories `only`, if given).

    override: found spans of a category stay if they overlap one of these categories.
    """

    def keep(f: Column) -> Column:
        meets = F.exists(existing, lambda e: overlapping(f, e) & (e["category"].isin(only) if only else F.lit(True)))
        stays = F.lit(False)
        for category, over in (override or {}).items():
            stays = stays | ((f["category"] == category) & F.exists(existing, lambda e: overlapping(f, e) & e["category"].isin(over)))
        return ~meets | stays

    return F.filter(found, keep)
