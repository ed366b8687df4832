"""Regex matches as arrays of spans with code-point offsets, without Python.

Matches are marked in the text by control characters and the text is cut at the first of them.  A cut
knows its length alone; offsets are the running sums, which `positions` makes here and
`operators.resolve` makes in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import checks
from .patterns import BENIGN_NAME, BENIGN_TOKENS, PATTERNS, RESERVED_HOSTS, Pattern

HIT = "struct<start:int,end:int,value:string>"
SPAN = "struct<category:string,start:int,end:int,value:string,confidence:double,validator_passed:boolean,needs_review:boolean,seq:int>"
#: categories with a checksum, and with hits that are surely not personal
CHECKED = ["tfn", "abn", "acn", "medicare", "bsb_account"]
SCREENED = ["username", "url", "generic_id"]
#: cuts whose running sums are made at once
_STRETCH = 128


def clean(text: Column) -> Column:
    """Null as empty; the marks replaced by U+FFFD, which keeps offsets."""
    return F.translate(F.coalesce(text, F.lit("")), "\x01\x02\x03", "���")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def groups_of(regex: str) -> int:
    """Capturing groups of a regex without named groups."""
    n, k, depth = 0, 0, 0
    while k < len(regex):
        c = regex[k]
        if c == "\\":
            k += 1
        elif c == "[":
            depth += 1
        elif c == "]":
            depth -= 1
        elif c == "(" and not depth and regex[k + 1 : k + 2] != "?":
            n += 1
        k += 1
    return n


def _marked(text: Column, regex: str) -> Column:
    """The text with U+0001 before and U+0002 behind each value, and U+0003 between the groups that it may be."""
    between = "\x03".join(f"${k}" for k in range(2, groups_of(regex) + 1))
    return F.regexp_replace(text, regex, "$1\x01" + between + "\x02")


def _value(part: Column) -> Column:
    """The value at the beginning of a part, with marks between groups."""
    return F.substring_index(part, "\x02", 1)


def cuts(text: Column, pattern: Pattern, strict: bool = False, values: bool = False) -> Column:
    """The text's parts, each from a hit to the next, as array<struct<size, n, drop, ok>>; null without hits.

    size: code points of the part; n: those of the value it begins with (-1: the part before all
    hits); drop: surely not personal; ok: whether the category's check holds (null: it has none); with
    `values` also the value itself.
    """
    def one(part: Column) -> Column:
        hit = F.contains(part, F.lit("\x02"))
        value = F.translate(_value(part), "\x03", "")
        marks = groups_of(pattern.regex) - 1
        bare = F.startswith(part, F.lit("\x03")) & ~F.startswith(part, F.lit("\x03\x03")) if pattern.category == "username" else F.lit(False)
        drop = benign(F.lit(pattern.category), value, strict, bare) if pattern.category in SCREENED else F.lit(False)
        ok = checks.passed(F.lit(pattern.category), value) if pattern.category in CHECKED else F.lit(None).cast("boolean")
        return F.struct(
            F.when(hit, F.char_length(part) - marks).otherwise(F.char_length(part)).alias("size"), F.when(hit, F.char_length(value)).otherwise(-1).alias("n"),
            F.coalesce(hit & drop, F.lit(False)).alias("drop"), F.when(hit, ok).alias("ok"), *([F.when(hit, value).alias("value")] if values else []),
        )

    parts = F.split(_marked(text, pattern.regex), "\x01")
    return F.when(text.rlike(pattern.needs), let(parts, lambda p: F.when(F.size(p) > 1, F.transform(p, one))))


def positions(sizes: Column) -> Column:
    """The sum of all sizes before each one, a stretch at a time, so that the work grows little faster than the array."""

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0), lambda a, b: a + b)

    def within(rows: Column) -> Column:
        return let(F.transform(rows, total), lambda sums: F.transform(rows, lambda x, k: let(total(F.slice(sums, 1, k)), lambda base: F.transform(x, lambda _, j: base + total(F.slice(x, 1, j))))))

    def stretches(s: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / _STRETCH).cast("int")), lambda k: F.slice(s, k * _STRETCH + 1, F.lit(_STRETCH)))

    return let(sizes, lambda s: F.when(F.size(s) > 0, F.flatten(let(stretches(s), within))).otherwise(F.array().cast("array<int>")))


def hits(text: Column, pattern: Pattern) -> Column:
    """Hits (start, end, value) of one pattern in a clean text, in order."""
    return F.transform(found(text, pattern), lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"), h["value"].alias("value")))


def found(text: Column, pattern: Pattern, strict: bool = False) -> Column:
    """Hits with (start, end, value, drop, ok)."""
    def placed(c: Column) -> Column:
        with_starts = F.zip_with(c, positions(F.transform(c, lambda x: x["size"])), lambda x, at: F.struct(at.alias("start"), x.alias("c")))
        return F.transform(
            F.filter(with_starts, lambda x: x["c"]["n"] >= 0),
            lambda x: F.struct(
                x["start"].alias("start"), (x["start"] + x["c"]["n"]).alias("end"), x["c"]["value"].alias("value"), x["c"]["drop"].alias("drop"), x["c"]["ok"].alias("ok"),
            ),
        )

    none = F.array().cast("array<struct<start:int,end:int,value:string,drop:boolean,ok:boolean>>")
    return F.coalesce(let(cuts(text, pattern, strict, values=True), placed), none)


def benign(category: Column, value: Column, strict: bool = False, bare: Column | None = None) -> Column:
    """Hits that are surely not personal: filler tokens, reserved hosts, four capitals and four digits.

    strict: of user names that stand without a label (bare) only those with one of @ . _ - stay.
    """
    v = F.regexp_replace(F.trim(value), r"[.,;:)]+$", "")
    low = F.lower(v)
    user = v.rlike(BENIGN_NAME) | low.isin(BENIGN_TOKENS)
    if strict:
        user = user | ((F.lit(False) if bare is None else bare) & ~v.rlike(r"[@._-]"))
    host = low == "localhost"
    for end in RESERVED_HOSTS:
        host = host | low.endswith(end)
    return ((category == "username") & user) | ((category == "url") & host) | ((category == "generic_id") & v.rlike(r"^[A-Z]{4}[0-9]{4}$"))


def chosen(categories: list[str] | None) -> list[tuple[int, Pattern]]:
    """Patterns with their place in the order of detection."""
    return [(k, p) for k, p in enumerate(PATTERNS) if categories is None or p.category in categories]


def as_spans(rows: Column, category: str, seq: int) -> Column:
    return F.transform(
        rows,
        lambda h: F.struct(
            F.lit(category).alias("category"), h["start"].alias("start"), h["end"].alias("end"), h["value"].alias("value"), F.lit(1.0).alias("confidence"),
            F.lit(None).cast("boolean").alias("validator_passed"), F.lit(False).alias("needs_review"), F.lit(seq).alias("seq"),
        ),
    )


def detect(text: Column, categories: list[str] | None = None, strict: bool = False) -> Column:
    """All hits of all patterns in a clean text, by pattern, then place, without benign ones."""
    every = [as_spans(F.filter(found(text, p, strict), lambda h: ~h["drop"]), p.category, k) for k, p in chosen(categories)]
    return F.concat(*every) if every else F.array().cast(f"array<{SPAN}>")


def validated(spans: Column) -> Column:
    """Fail closed: a span that fails its check stays, at half confidence and for review."""

    def one(s: Column) -> Column:
        ok = checks.passed(s["category"], s["value"])
        bad = F.coalesce(~ok, F.lit(False))
        return F.struct(
            s["category"].alias("category"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"),
            F.when(bad, F.least(s["confidence"], F.lit(0.5))).otherwise(s["confidence"]).alias("confidence"), ok.alias("validator_passed"),
            (s["needs_review"] | bad).alias("needs_review"), s["seq"].alias("seq"),
        )

    return F.transform(spans, one)


def occurrences(text: Column, value: Column, start: Column | int = 0) -> Column:
    """Starts of all occurrences of a literal value from a place on, none overlapping."""
    rest = F.substring(text, F.lit(start) + 1, F.char_length(text))
    size = F.char_length(value)
    parts = F.split(F.replace(rest, value, F.lit("\x01")), "\x01")
    # each part but the last is followed by the value
    steps = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.char_length(p) + size)
    ends = let(steps, lambda s: F.zip_with(s, positions(s), lambda a, b: a + b))
    return F.when(size > 0, F.transform(ends, lambda e: (e - size + F.lit(start)).cast("int"))).otherwise(F.array().cast("array<int>"))


def chunks(text: Column, size: int, overlap: int) -> Column:
    """Windows (chunk, offset) of a text: the whole text if it fits, else every size - overlap code points."""
    if overlap >= size:
        raise ValueError("the overlap is to be less than the chunk size")
    n = F.char_length(text)
    starts = F.when(n <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size - overlap)))
    return F.transform(starts, lambda i: F.struct(F.substring(text, i + 1, F.when(n <= size, n).otherwise(F.lit(size))).alias("chunk"), i.alias("offset")))
