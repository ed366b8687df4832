"""Which category a candidate from a model belongs to, and whether a model is worth calling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import checks

# The words that tell a street or postal address from a place.
POSTAL_BOX = r"(?i)\b(?:P\.?O\.?\s*Box|GPO\s*Box|Locked\s+Bag|Private\s+Bag)\s*\d+"
STREET = (
    r"(?i)\b(?:street|st|road|rd|avenue|ave|lane|ln|drive|dr|crescent|cres|court|ct|place|pl|way|highway|hwy|parade|pde|boulevard|blvd|terrace|tce|close|cl|"
    r"circuit|cct|esplanade|esp|square|sq|mews|walk|track|trail|loop|rise|view|vista|grove|gardens|gdns)\b"
)
POSTCODE = r"\b\d{4}\b"

# Label words before an identifier, in the order they are tried.
LABELS = [
    ("tfn", r"(?i)\b(?:tfn|tax\s+file\s+number)\b"),
    ("abn", r"(?i)\babn\b|\baustralian\s+business\s+number\b"),
    ("acn", r"(?i)\bacn\b|\baustralian\s+company\s+number\b"),
    ("medicare", r"(?i)\bmedicare\b"),
    ("healthcare_identifier", r"(?i)\b(?:ihi|individual\s+healthcare\s+identifier|healthcare\s+identifier)\b"),
    ("medical_record_number", r"(?i)\b(?:mrn|medical\s+record\s+number|hospital\s+ur(?:n)?)\b"),
    ("bsb_account", r"(?i)\b(?:bsb|bank\s+state\s+branch)\b"),
    ("passport", r"(?i)\bpassport\b"),
    ("driver_licence", r"(?i)\bdriver(?:'s)?\s+licen[cs]e\b|\bdl\b|\blicen[cs]e\s+number\b"),
    ("centrelink_crn", r"(?i)\b(?:centrelink|crn|customer\s+reference\s+number)\b"),
    ("username", r"(?i)\b(?:username|handle|login|screen\s*name|account\s*name)s?\b"),
]
RECORD_LABEL, RECORD_SHAPE = r"(?i)\b(?:mrn|medical\s+record\s+number|hospital\s+ur(?:n)?|urn)\b", r"(?i)^[A-Z]?\d{4,10}$"

# Words of clinical and legal narrative.
NARRATIVE = (
    r"(?i)\b(?:the patient|the client(?!'s account)|the resident|patient\s+[A-Z][a-z]+|the deceased|the defendant|the plaintiff|diagnosed with|presenting with|presented with|"
    r"admitted (?:to|with|for|after)|discharged from|clinician|physician|psychiatrist|outpatient|inpatient|medical history|chief complaint|assessment and plan|"
    r"a/prof\.?\s+[A-Z][a-z]+|prof\.?\s+[A-Z][a-z]+|dr\.?\s+[A-Z][a-z]+|\bmrn[-:]\s*[A-Z0-9])"
)


def address_or_location(value: Column) -> Column:
    """A box, a postcode or a street word makes an address; all else is a location."""
    v = F.trim(F.coalesce(value, F.lit("")))
    return F.when(v.rlike(POSTAL_BOX) | v.rlike(POSTCODE) | v.rlike(STREET), "address").otherwise("location")


def label_before(text: Column, start: Column, value: Column, window: int = 40) -> Column:
    """The category of the label within `window` code points before a value, or null.

    A line end, semicolon, comma or full stop between them breaks the binding.
    """
    left = F.greatest(start - window, F.lit(0))
    snippet = F.substring(text, left + 1, start - left)
    for separator in ("\n", ";", ",", ". "):
        snippet = F.substring_index(snippet, separator, -1)
    out = F.when(F.trim(value).rlike(RECORD_SHAPE) & snippet.rlike(RECORD_LABEL), "medical_record_number")
    for category, regex in LABELS:
        out = out.when(snippet.rlike(regex), category)
    return out


def resolve(value: Column, label: Column, source: Column) -> Column:
    """The category of a candidate: by its label, its prefix, a checksum, its shape, else generic_id."""
    v = F.trim(value)
    shape = (
        F.when(v.rlike(r"^\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}$"), "healthcare_identifier").when(v.rlike(r"^\d{9}[A-Za-z]$"), "centrelink_crn")
        .when(v.rlike(r"(?i)^[A-Z]{1,2}\d{7}$"), "passport").when(v.rlike(r"(?i)^[A-Z]{0,2}\d{6,9}$") & (F.length(v) >= 7), "driver_licence")
    )
    handle = F.when((source == "secret") & v.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]{2,31}$") & v.rlike("[A-Za-z]"), "username")
    prefix = F.when(v.rlike(r"(?i)^(?:MRN|URN?)[-_:]\s?\w"), "medical_record_number")
    return F.coalesce(label, prefix, checks.first_passing(value), shape, handle, F.lit("generic_id"))


def worth_a_model(text: Column, scores: Column, mode: str = "confidence", min_score: float = 0.7, min_tokens: int = 200) -> Column:
    """struct(invoke, reason): whether a text is to go to the costly model.

    A narrative word, a long text, or two or more spans below min_score say so.
    """
    if mode in ("always", "never"):
        return F.struct(F.lit(mode == "always").alias("invoke"), F.lit(f"mode={mode}").alias("reason"))
    t = F.coalesce(text, F.lit(""))
    n = F.size(F.filter(F.split(t, r"\s+"), lambda x: x != ""))
    low = F.size(F.filter(F.coalesce(scores, F.array().cast("array<double>")), lambda s: s < min_score))
    reason = (
        F.when(t.rlike(NARRATIVE), F.lit("narrative_cue")).when(n >= min_tokens, F.concat(F.lit("tokens="), n.cast("string"), F.lit(f">={min_tokens}")))
        .when(low >= 2, F.concat(F.lit("openai_low_conf="), low.cast("string"), F.lit(f"<{min_score:.2f}")))
    )
    return F.struct(reason.isNotNull().alias("invoke"), F.coalesce(reason, F.concat(F.lit("skip(tokens="), n.cast("string"), F.lit(",spans="), F.size(F.coalesce(scores, F.array().cast("array<double>"))).cast("string"), F.lit(")"))).alias("reason"))
