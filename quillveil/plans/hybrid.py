"""The hybrid plan: model candidates, resolved; patterns where models saw nothing; organisations and locations; the pattern floor; merged by priority."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import checks
from ..functions import recognise as G
from ..functions import resolve_category as R
from ..functions import spans as S
from ..functions.adapters import SpanModel
from ..functions.patterns import BLANK
from ..operators import resolve
from ..operators.resolve import Span
from ..ship import ship
from .redaction import small_batches, spread

CANDIDATES = "array<struct<label:string,start:int,end:int,value:string,score:double>>"
_KIND = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("score", pa.float64())]))
RESOLVED = "array<struct<category:string,start:int,end:int,value:string,confidence:double,validator_passed:boolean,needs_review:boolean>>"

# The labels of three families of span models, and the categories that patterns know better than models.
LABELS = {
    "private_person": "name", "private_address": "address", "private_email": "email", "private_phone": "phone", "private_date": "date", "private_url": "url", "account_number": "generic_id", "secret": "generic_id",
    "GIVENNAME": "name", "SURNAME": "name", "EMAIL": "email", "TELEPHONENUM": "phone", "CITY": "location", "STREET": "address", "BUILDINGNUM": "address", "ZIPCODE": "address", "DATEOFBIRTH": "date_of_birth",
    "DRIVERLICENSENUM": "driver_licence", "USERNAME": "generic_id", "ACCOUNTNUM": "generic_id", "TAXNUM": "generic_id", "SOCIALNUM": "generic_id", "IDCARDNUM": "generic_id", "CREDITCARDNUMBER": "generic_id",
    "PASSWORD": "generic_id", "person": "name", "organization": "organisation", "address": "address", "location": "location", "email": "email", "phone number": "phone", "date of birth": "date_of_birth",
    "date": "date", "driver's license number": "driver_licence", "passport number": "generic_id", "credit card number": "generic_id", "bank account number": "generic_id",
    "tax identification number": "generic_id", "social security number": "generic_id", "username": "generic_id", "ip address": "generic_id",
}
HIGH_VALUE = [
    "phone", "address", "email", "url", "ip_address", "tfn", "abn", "acn", "medicare", "bsb_account", "healthcare_identifier", "medical_record_number", "centrelink_crn", "driver_licence", "passport", "patient_id",
]
#: a pattern's hit stays although a model saw something there, if what it saw is one of these
OVERRIDE = {"username": ["name", "generic_id"]}


def high_value(username: bool = True) -> list[str]:
    return [*HIGH_VALUE, "username"] if username else list(HIGH_VALUE)


def with_candidates(docs: DataFrame, model: SpanModel | None, text_col: str = "text", name: str = "candidates", only_if: str | None = None) -> DataFrame:
    """docs with a model's candidates; a text on which the model fails has null, and goes on with patterns alone.

    only_if: a boolean column that says which texts are worth the model; others have none.
    """
    if model is None:
        return docs.withColumn(name, F.array().cast(CANDIDATES))
    ship(docs.sparkSession)
    small_batches(docs)
    at, asked = docs.columns.index(text_col), docs.columns.index(only_if) if only_if else None

    def one(text: str | None, wanted: bool | None) -> list[dict[str, Any]] | None:
        if not text or not wanted:
            return []
        try:
            return [dict(zip(("label", "start", "end", "value", "score"), f)) for f in model.predict(text)]
        except Exception:  # a model's failure must not let a text through unseen: the floor still holds
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            wanted = b.column(asked).to_pylist() if asked is not None else [True] * len(texts)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(map(one, texts, wanted)), _KIND)], [*b.schema.names, name])

    return docs.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"{name} {CANDIDATES}"]))


def trimmed(text: Column, candidates: Column, floor: float = 0.0) -> Column:
    """Candidates of a score (none counts as 1) at or above the floor, with places inside the text, drawn in to what isn't blank."""
    n = F.char_length(text)

    def inside(c: Column) -> Column:
        return (F.coalesce(c["score"], F.lit(1.0)) >= floor) & c["label"].isNotNull() & (c["start"] >= 0) & (c["end"] > c["start"]) & (c["end"] <= n)

    def drawn_in(c: Column) -> Column:
        raw = F.substring(text, c["start"] + 1, c["end"] - c["start"])
        left, both = F.regexp_replace(raw, f"^{BLANK}+", ""), F.regexp_replace(raw, f"^{BLANK}+|{BLANK}+$", "")
        start = c["start"] + F.char_length(raw) - F.char_length(left)
        return F.struct(c["label"].alias("label"), start.alias("start"), (start + F.char_length(both)).alias("end"), both.alias("value"), F.coalesce(c["score"], F.lit(1.0)).alias("score"))

    return F.filter(F.transform(F.filter(F.coalesce(candidates, F.array().cast(CANDIDATES)), inside), drawn_in), lambda c: c["end"] > c["start"])


def resolved(text: Column, candidates: Column) -> Column:
    """Candidates as spans: account numbers and secrets by label, prefix, checksum or shape; addresses told from places; all others by LABELS.

    A labelled identifier that fails its check is kept, at half confidence and for review.
    """
    table = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])

    def one(c: Column) -> Column:
        number = c["label"].isin("account_number", "secret")
        label = R.label_before(text, c["start"], c["value"])
        by_rule = R.resolve(c["value"], label, c["label"])
        plain = F.when(c["label"] == "private_address", R.address_or_location(c["value"])).otherwise(F.coalesce(F.try_element_at(table, c["label"]), F.lit("generic_id")))
        # without a label, a checked category is one whose check has passed
        ok = F.when(number, F.when(label.isNotNull(), checks.passed(label, c["value"])).otherwise(F.when(by_rule.isin(S.CHECKED), F.lit(True))))
        bad = F.coalesce(~ok, F.lit(False))
        return F.struct(
            F.when(number, by_rule).otherwise(plain).alias("category"), c["start"].alias("start"), c["end"].alias("end"), c["value"].alias("value"),
            F.when(bad, 0.5).otherwise(1.0).alias("confidence"), ok.alias("validator_passed"), bad.alias("needs_review"),
        )

    return F.transform(candidates, one)


class Cover:
    """Whether a range overlaps any of some spans: their starts in order, and how far those up to each reach."""

    def __init__(self, spans: list[Span]):
        own = sorted(spans, key=lambda s: s.start)
        self.starts = [s.start for s in own]
        self.reach = list(accumulate((s.end for s in own), max))

    def meets(self, start: int, end: int) -> bool:
        k = bisect_left(self.starts, end)
        return k > 0 and self.reach[k - 1] > start


def supplement(known: list[Span], hits: list[Span], categories: list[str]) -> list[Span]:
    """Pattern hits of some categories that overlap nothing known, or something that the override lets them."""
    every = Cover(known)
    weaker = {c: Cover([s for s in known if s.category in over]) for c, over in OVERRIDE.items()}
    return [h for h in hits if h.category in categories and (not every.meets(h.start, h.end) or h.category in weaker and weaker[h.category].meets(h.start, h.end))]


def hybrid_table(
    docs: DataFrame, candidates: str = "candidates", gazetteers: G.Gazetteers | None = None, id_col: str = "doc_id", text_col: str = "text", style: str = "numbered", floor: float = 0.0, username: bool = True,
    organisations: bool = True, locations: bool = True, use_patterns: bool = True, strict: bool = False, keep_values: bool = False, keep_cover: bool = False, texts: bool = True,
) -> DataFrame:
    """document_id, redacted_text, pii_count, needs_review, spans, by model candidates and patterns together.

    docs: id, text, and the candidates column of `with_candidates` (null: the model failed).  Shapes, checks and categories are worked out in
    the JVM, what depends on neighbours in one pass in Arrow batches.  keep_cover: winners of the merge take over what losers covered, so
    nothing found stays in the text; without it winners keep their own bounds.
    """
    ship(docs.sparkSession)
    small_batches(docs)
    base = spread(docs.select(F.col(id_col).alias("document_id"), S.clean(F.col(text_col)).alias("_t"), F.col(candidates).alias("_m")))
    every = S.chosen(None) if use_patterns else []
    only = [*(G.ORGANISATIONS if organisations else []), *(G.LOCATIONS if locations else [])] if use_patterns else []
    shapes = G.patterns(only) if only else []
    names, more = [p.category for _, p in every], [p.category for p in shapes]
    table = base.select(
        "document_id", "_t", resolved(F.col("_t"), trimmed(F.col("_t"), F.col("_m"), floor)).alias("_m"),
        *[S.cuts(F.col("_t"), p, strict).alias(f"_c{k}") for k, p in every], *[S.cuts(F.col("_t"), p).alias(f"_r{k}") for k, p in enumerate(shapes)],
    )
    given, wanted = gazetteers or G.Gazetteers(), high_value(username)
    shared = docs.sparkSession.sparkContext.broadcast(given)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recogniser = G.Recogniser(shared.value, only)
        for batch in batches:
            own, models = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            hits = resolve.hits_of(batch.columns[3 : 3 + len(names)], names, batch.num_rows)
            shapes_hit = resolve.hits_of(batch.columns[3 + len(names) :], more, batch.num_rows)
            redacted, review, out = [], [], []
            for text, candidates_, found, shape in zip(own, models, hits, shapes_hit):
                spans = [Span(**c) for c in candidates_]
                floor_spans = resolve.spans_of(text, found)
                spans += supplement(spans, [s._replace(confidence=1.0, validator_passed=None, needs_review=False) for s in floor_spans], wanted)
                if only:
                    taken = Cover([s for s in spans if s.category in G.SUPPRESSING])
                    for category, some in zip(("organisation", "location"), recogniser.spans(text, shape)):
                        spans += [Span(category, a, b, text[a:b], 1.0 if sure else 0.85, True if sure else None, False) for a, b, sure in some if not taken.meets(a, b)]
                spans = resolve.by_priority(text, spans + floor_spans, keep_cover)
                shown = resolve.placeholders(spans, style)
                redacted.append(resolve.splice(text, spans, shown) if texts else None)
                review.append(any(s.needs_review for s in spans))
                out.append([(*(s if keep_values else s._replace(value=None)), p) for s, p in zip(spans, shown)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(redacted, pa.string()), pa.array([len(s) for s in out], pa.int32()), pa.array(review, pa.bool_()), resolve.span_lists(out)],
                ["document_id", "redacted_text", "pii_count", "needs_review", "spans"],
            )

    id_type = table.schema["document_id"].dataType.simpleString()
    return table.mapInArrow(run, f"document_id {id_type}, {resolve.OUT}")


def recognise_table(docs: DataFrame, gazetteers: G.Gazetteers, id_col: str = "doc_id", text_col: str = "text", only: list[str] | None = None) -> DataFrame:
    """(document_id, category, start, end, value, confidence, validator_passed) of organisations and locations, by all recognisers or those named."""
    ship(docs.sparkSession)
    small_batches(docs)
    base = spread(docs.select(F.col(id_col).alias("document_id"), S.clean(F.col(text_col)).alias("_t")))
    shapes = G.patterns(only)
    names = [p.category for p in shapes]
    shared = docs.sparkSession.sparkContext.broadcast(gazetteers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recogniser = G.Recogniser(shared.value, only)
        for batch in batches:
            rows, which = [], []
            for k, (text, hits) in enumerate(zip(batch.column(1).to_pylist(), resolve.hits_of(batch.columns[2:], names, batch.num_rows))):
                for category, some in zip(("organisation", "location"), recogniser.spans(text, hits)):
                    rows += [(category, a, b, text[a:b], 1.0 if sure else 0.85, True if sure else None) for a, b, sure in some]
                    which += [k] * len(some)
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.bool_()]
            cols = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.array(which, np.int64))), *cols], ["document_id", "category", "start", "end", "value", "confidence", "validator_passed"])

    table = base.select("document_id", "_t", *[S.cuts(F.col("_t"), p).alias(f"_r{k}") for k, p in enumerate(shapes)])
    id_type = table.schema["document_id"].dataType.simpleString()
    return table.mapInArrow(run, f"document_id {id_type}, category string, start int, end int, value string, confidence double, validator_passed boolean")


def with_narrative(docs: DataFrame, model: SpanModel | None, text_col: str = "text", candidates: str = "candidates", mode: str = "confidence", min_score: float = 0.7, min_tokens: int = 200) -> DataFrame:
    """docs with the narrative model's candidates added to those there, for the texts that the gate lets through; `gate` says which, and why."""
    gate = R.worth_a_model(F.col(text_col), F.transform(F.coalesce(candidates, F.array().cast(CANDIDATES)), lambda c: F.coalesce(c["score"], F.lit(1.0))), mode, min_score, min_tokens)
    gated = docs.withColumn("gate", gate).withColumn("_asked", F.col("gate.invoke"))
    more = with_candidates(gated, model, text_col, "_more", "_asked")
    both = F.concat(F.coalesce(candidates, F.array().cast(CANDIDATES)), F.coalesce("_more", F.array().cast(CANDIDATES)))
    return more.withColumn(candidates, F.when(F.col(candidates).isNull() & F.col("_more").isNull(), F.lit(None)).otherwise(both)).drop("_more", "_asked")


def gate_stats(gated: DataFrame, mode: str = "confidence", min_score: float = 0.7, min_tokens: int = 200) -> DataFrame:
    """One row: how often the gate let a text through."""
    n, yes = F.count("*"), F.count_if("gate.invoke")
    return gated.agg(
        F.lit(mode).alias("mode"), F.lit(min_score).alias("min_score"), F.lit(min_tokens).alias("min_tokens"), yes.alias("invocations"), (n - yes).alias("skips"),
        F.when(n > 0, yes / n).otherwise(0.0).alias("invoke_rate"), n.alias("documents_processed"),
    )
