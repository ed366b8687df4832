"""Placeholders and redacted texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STYLES = ("numbered", "category", "asterisk")


def with_placeholders(spans: Column, style: str = "numbered") -> Column:
    """Add a field `placeholder` to disjoint spans in order.

    numbered: values of a category are counted by first appearance in the document, equal
    values share a number; spans without a value and the category style name the category alone.
    """
    if style not in STYLES:
        raise ValueError(f"unknown placeholder style {style!r}; known: {', '.join(STYLES)}")
    if style == "asterisk":
        return F.transform(spans, lambda s: s.withField("placeholder", F.repeat(F.lit("*"), s["end"] - s["start"])))

    def label(s: Column) -> Column:
        return F.concat(F.lit("[REDACTED_"), F.upper(s["category"]))

    if style == "category":
        return F.transform(spans, lambda s: s.withField("placeholder", F.concat(label(s), F.lit("]"))))
    # distinct (category, value) in order of first appearance
    keys = F.array_distinct(F.transform(F.filter(spans, lambda s: s["value"].isNotNull()), lambda s: F.struct(s["category"].alias("c"), s["value"].alias("v"))))

    def number(s: Column) -> Column:
        own = F.filter(keys, lambda k: k["c"] == s["category"])
        return F.array_position(F.transform(own, lambda k: k["v"]), s["value"])

    return F.transform(
        spans,
        lambda s: s.withField(
            "placeholder", F.when(s["value"].isNull(), F.concat(label(s), F.lit("]"))).otherwise(F.concat(label(s), F.format_string("_%03d]", number(s))))
        ),
    )


def splice(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its placeholder; spans are disjoint and in order."""
    pieces = F.transform(
        spans,
        lambda s, i: F.concat(
            F.substring(text, F.when(i == 0, F.lit(0)).otherwise(F.coalesce(F.get(spans, i - 1)["end"], F.lit(0))) + 1, s["start"] - F.when(i == 0, F.lit(0)).otherwise(F.coalesce(F.get(spans, i - 1)["end"], F.lit(0)))),
            F.coalesce(s["placeholder"], F.lit("")),
        ),
    )
    end = F.coalesce(F.try_element_at(spans, F.lit(-1))["end"], F.lit(0))
    return F.concat(F.array_join(pieces, ""), F.substring(text, end + 1, F.char_length(text)))


def safe(spans: Column) -> Column:
    """Spans without their values."""
    return F.transform(spans, lambda s: s.dropFields("value", "seq"))


def segments(text: Column, spans: Column) -> Column:
    """Alternating plain and labelled runs that cover the text: (text, category or null)."""
    def run(start: Column, end: Column, category: Column) -> Column:
        return F.struct(F.substring(text, start + 1, end - start).alias("text"), category.alias("category"))

    none = F.lit(None).cast("string")
    inner = F.flatten(F.transform(spans, lambda s, i: F.array(run(F.when(i == 0, F.lit(0)).otherwise(F.coalesce(F.get(spans, i - 1)["end"], F.lit(0))), s["start"], none), run(s["start"], s["end"], s["category"]))))
    tail = F.array(run(F.coalesce(F.try_element_at(spans, F.lit(-1))["end"], F.lit(0)), F.char_length(text), none))
    return F.filter(F.concat(inner, tail), lambda x: F.char_length(x["text"]) > 0)
