"""Queries of organisation and location recognisers, candidates and the hybrid plan, over texts made from the customers' numbers."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ..functions import resolve_category as R
from ..functions import spans as S
from ..functions.recognise import Gazetteers
from . import hybrid
from .registry import query, table

#: a small gazetteer, as a run would pass its own
KNOWN = Gazetteers(
    ["Harbour Bridge Authority", "Harbour Bridge Authority of Works", "Blue Gum Bank"], {"HBA": "Harbour Bridge Authority", "BGB": "Blue Gum Bank"},
    {"Glebe": {"NSW"}, "Park": {"VIC"}, "Cherry Valley": set()}, {"2037": {("Glebe", "NSW")}},
)
#: texts for each recogniser, and what it finds there
CASES: dict[str, list[tuple[str, list[str]]]] = {
    "gazetteer": [("see Harbour Bridge Authority of Works now", ["Harbour Bridge Authority of Works"]), ("Blue Gum Bank, Blue Gum Bank", ["Blue Gum Bank"] * 2), ("Blue Gum Banks or blue gum bank", [])],
    "suffix": [("from Acme Tools Pty Ltd today", ["Acme Tools Pty Ltd"]), ("the Wong & Sons Lawyers case", ["Wong & Sons Lawyers"]), ("DEN0001 Clinic and acme trust", [])],
    "department": [("Department of Health and Aged Care wrote", ["Department of Health and Aged Care"]), ("an Office for Women", ["Office for Women"]), ("department of health", [])],
    "hospital": [("at Royal Perth Hospital today", ["Royal Perth Hospital"]), ("St Vincent Hospital", ["St Vincent Hospital"]), ("a Hospital", [])],
    "university": [("the University of New England", ["University of New England"]), ("Macquarie University has", ["Macquarie University"]), ("a university", [])],
    "facility": [("Bayside Medical Centre", ["Bayside Medical Centre"]), ("Northside GP Clinic rang", ["Northside GP Clinic"]), ("Medical Centre", [])],
    "partners": [("Smith & Partners", ["Smith & Partners"]), ("Jones and Associates Solicitors act", ["Jones and Associates Solicitors"]), ("smith and partners", [])],
    "practice": [("Eastern Medical Practice", ["Eastern Medical Practice"]), ("Family Law Practice", ["Family Law Practice"]), ("Practice address", [])],
    "acronym": [("the HBA, Harbour Bridge Authority", ["HBA"]), ("BGB is a blue gum lender", ["BGB"]), ("HBA alone, and PDF", [])],
    "state": [("NSW or VIC", ["NSW", "VIC"]), ("ACTS and Act", []), ("WA.", ["WA"])],
    "state_name": [("in New South Wales", ["New South Wales"]), ("Victoria, Tasmania", ["Victoria", "Tasmania"]), ("victorian", [])],
    "postcode": [("Glebe 2037", ["2037"]), ("2037 NSW", ["2037"]), ("the year 2037, or 9999 apart", [])],
    "suburb": [("of Glebe and Cherry Valley", ["Glebe", "Cherry Valley"]), ("Park, VIC", ["Park"]), ("Park bench", [])],
    "region": [("near Greater Sydney", ["Greater Sydney"]), ("North Glebe", ["North Glebe"]), ("North Pole", [])],
    "informal": [("the Inner West", ["Inner West"]), ("Mid-North Coast and Far North Queensland", ["Mid-North Coast", "Far North Queensland"]), ("inner west", [])],
    "named": [("down the Yarra Valley", ["the Yarra Valley"]), ("PILBARA", ["PILBARA"]), ("a valley", [])],
    "cbd": [("Sydney CBD", ["Sydney CBD"]), ("CBD of Perth", ["CBD of Perth"]), ("Darwin Central Business District", ["Darwin Central Business District"])],
}


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _cases(spark, sf_dir, texts: list[str]):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("doc_id"), F.get(F.array(*map(F.lit, texts)), (k % len(texts)).cast("int")).alias("text"))


def _recognised(spark, sf_dir, only: str):
    return hybrid.recognise_table(_cases(spark, sf_dir, [t for t, _ in CASES[only]]), KNOWN, only=[only]).select("document_id", "category", "value", "start", "end")


def _recognised_sql(only: str, cases: list[tuple[str, list[str]]]) -> str:
    rows = []
    for k, (text, found) in enumerate(cases):
        at = 0
        for v in found:
            at = text.index(v, at)
            rows.append(f"({k}, {_quote(v)}, {at}, {at + len(v)})")
            at += len(v)
    category = "organisation" if only in ("gazetteer", "suffix", "department", "hospital", "university", "facility", "partners", "practice", "acronym") else "location"
    return f'SELECT c_custkey AS document_id, \'{category}\' AS category, value, start::INT AS start, "end"::INT AS "end" FROM customer JOIN (VALUES {", ".join(rows)}) AS v(k, value, start, "end") ON c_custkey % {len(cases)} = k'


for _name, _texts in CASES.items():
    query(_recognised_sql(_name, _texts), ("org_" if _recognised_sql(_name, _texts).count("'organisation'") else "loc_") + _name)(partial(_recognised, only=_name))

#: texts for each of the patterns, with blanks of other kinds too, and the values found there
PATTERN_CASES: dict[str, list[tuple[str, list[str]]]] = {
    "abn": [("ABN 51 824 753 556.", ["51 824 753 556"]), ("51\u00a0824\u00a0753\u00a0556 and 33051775556", ["51\u00a0824\u00a0753\u00a0556", "33051775556"]), ("1233051775556", [])],
    "tfn": [("TFN 123 456 782", ["123 456 782"]), ("123\u00a0456\u00a0782, 12345678", ["123\u00a0456\u00a0782", "12345678"]), ("1234567 or 1234567890", [])],
    "acn": [("004-085-616", ["004-085-616"]), ("004\u2003085\u2003616", ["004\u2003085\u2003616"]), ("004 085 6167", [])],
    "medicare": [("2957 20197 1-1", ["2957 20197 1-1"]), ("2957\u00a020197\u00a01", ["2957\u00a020197\u00a01"]), ("29572019", [])],
    "bsb_account": [("BSB 062-000, 083\u00a0000", ["062-000", "083\u00a0000"]), ("0620001", []), ("062 000", ["062 000"])],
    "patient_id": [("Patient ID: PT-448812.", ["PT-448812"]), ("pt\u00a0id 12345", ["12345"]), ("patient 12", [])],
    "medical_record_number": [("MRN HOSP-998271", ["HOSP-998271"]), ("Medical record\u00a0no. A1234", ["A1234"]), ("mrn 12", [])],
    "healthcare_identifier": [("IHI 8003 6000 0000 0000", ["8003 6000 0000 0000"]), ("healthcare identifier: 8003\u00a06000\u00a00000\u00a00000", ["8003\u00a06000\u00a00000\u00a00000"]), ("8003 6000 0000 0000", [])],
    "name": [("Patient: Mary-Anne O'Connor", ["Mary-Anne O'Connor"]), ("next of kin -\u00a0Jo Lee", ["Jo Lee"]), ("Patient mary lee", [])],
    "passport": [("PA1234567 x", ["PA1234567"]), ("N1234567.", ["N1234567"]), ("PAX1234567", [])],
    "driver_licence": [("NS123456", ["NS123456"]), ("1234567", ["1234567"]), ("NSW123456", [])],
    "centrelink_crn": [("123456789A", ["123456789A"]), ("é123456789A", []), ("123456789AB", [])],
    "phone": [("(02) 9374 4000", ["(02) 9374 4000"]), ("0412\u00a0345\u00a0678 or +45 12 34 56 78", ["0412\u00a0345\u00a0678", "+45 12 34 56 78"]), ("12 34", [])],
    "email": [("mail a.b+c@ex-ample.com.au.", ["a.b+c@ex-ample.com.au"]), ("é.a@b.co", ["a@b.co"]), ("a@b", [])],
    "url": [("see https://a.org/x?y=1 now", ["https://a.org/x?y=1"]), ("www.site.org/x or site.org", ["www.site.org/x", "site.org"]), ("x.test, localhost", [])],
    "address": [("at 12 Long Street, Perth WA 6000", ["12 Long Street, Perth WA 6000"]), ("12\u00a0Long\u00a0Street", ["12\u00a0Long\u00a0Street"]), ("12 Long", [])],
    "username": [("username: alice99", ["alice99"]), ("by @jo_s and jo.smith1", ["@jo_s", "jo.smith1"]), ("alpha123 or retry_limit", [])],
    "generic_id": [("case no: ZX-77", ["ZX-77"]), ("AB:12345 and 123-12-1234", ["AB:12345", "123-12-1234"]), ("ABCD1234", [])],
    "date": [("on 12/03/2024", ["12/03/2024"]), ("May\u00a01\u00a02024, 1st. May 24", ["May\u00a01\u00a02024", "1st. May 24"]), ("soon", [])],
    "ip_address": [("10.0.0.255 up", ["10.0.0.255"]), ("1.2.3.4.5", ["1.2.3.4"]), ("256.1.1.1", ["6.1.1.1"] * 0)],
}


def _matched(spark, sf_dir, only: str):
    rows = _cases(spark, sf_dir, [t for t, _ in PATTERN_CASES[only]]).select("doc_id", S.detect(S.clean(F.col("text")), [only]).alias("s"))
    return rows.select(F.col("doc_id").alias("document_id"), F.inline("s")).select("document_id", "category", "value", "start", "end")


for _name, _texts in PATTERN_CASES.items():
    query(_recognised_sql(_name, _texts).replace("'location' AS category", f"'{_name}' AS category"), f"pattern_{_name}")(partial(_matched, only=_name))

#: candidates of models, in the terms of their labels, and what they count as
LABELLED = [(label, category) for label, category in hybrid.LABELS.items() if label not in ("account_number", "secret", "private_address")]
ROUTED = [
    ("account_number", "TFN: ", "999 999 999", "tfn", "false"), ("account_number", "ABN ", "51 824 753 556", "abn", "true"), ("account_number", "no ", "062-000", "bsb_account", "true"),
    ("account_number", "no ", "MRN-12345", "medical_record_number", "NULL"), ("account_number", "no ", "zz", "generic_id", "NULL"), ("secret", "no ", "jo_smith", "username", "NULL"),
    ("private_address", "at ", "12 Long Street", "address", "NULL"), ("private_address", "at ", "Greater Sydney", "location", "NULL"),
]


def _one_candidate(rows):
    return hybrid.resolved(F.col("text"), F.array(F.struct("label", F.col("start").cast("int").alias("start"), (F.col("start") + F.char_length("value")).cast("int").alias("end"), "value", F.lit(1.0).alias("score"))))


@query(f"""SELECT c_custkey AS k, label, category FROM customer JOIN (VALUES {", ".join(f"({k}, {_quote(a)}, {_quote(b)})" for k, (a, b) in enumerate(LABELLED))}) AS v(i, label, category) ON c_custkey % {len(LABELLED)} = i""")
def candidate_labels(spark, sf_dir):
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k.alias("k"), F.get(F.array(*[F.lit(a) for a, _ in LABELLED]), (k % len(LABELLED)).cast("int")).alias("label"), F.lit("some value").alias("text"), F.lit("value").alias("value"), F.lit(5).alias("start"))
    return rows.select("k", "label", F.get(_one_candidate(rows), F.lit(0))["category"].alias("category"))


@query(f"""SELECT c_custkey AS k, category, ok AS validator_passed, coalesce(NOT ok, false) AS needs_review, CASE WHEN NOT ok THEN 0.5 ELSE 1.0 END::DOUBLE AS confidence
FROM customer JOIN (VALUES {", ".join(f"({k}, {_quote(c)}, {ok}::BOOLEAN)" for k, (_, _, _, c, ok) in enumerate(ROUTED))}) AS v(i, category, ok) ON c_custkey % {len(ROUTED)} = i""")
def candidate_routing(spark, sf_dir):
    k = F.col("c_custkey")

    def of(n):
        return F.get(F.array(*[F.lit(r[n]) for r in ROUTED]), (k % len(ROUTED)).cast("int"))

    rows = table(spark, sf_dir, "customer").select(k.alias("k"), of(0).alias("label"), F.concat(of(1), of(2)).alias("text"), of(2).alias("value"), F.char_length(of(1)).alias("start"))
    return rows.select("k", F.get(_one_candidate(rows), F.lit(0)).alias("s")).select("k", "s.category", "s.validator_passed", "s.needs_review", "s.confidence")


@query("""SELECT c_custkey AS k, 2 + c_custkey % 3 AS start, (2 + c_custkey % 3 + length(c_name))::BIGINT AS "end", c_name AS value FROM customer WHERE c_custkey % 10 >= 4""")
def candidates_trimmed(spark, sf_dir):
    k = F.col("c_custkey")
    pad = F.repeat(F.lit(" "), (k % 3).cast("int"))
    text = F.concat(F.lit("a "), pad, F.col("c_name"), F.lit("\u00a0 z"))
    n = F.char_length("c_name") + k % 3
    c = F.struct(F.lit("private_person").alias("label"), F.lit(2).alias("start"), (F.lit(2) + n + 2).cast("int").alias("end"), F.lit("").alias("value"), (k % 10 / 10).alias("score"))
    out_of_text = F.struct(F.lit("x").alias("label"), F.lit(0).alias("start"), F.lit(9999).alias("end"), F.lit("").alias("value"), F.lit(1.0).alias("score"))
    rows = table(spark, sf_dir, "customer").select(k.alias("k"), F.inline(hybrid.trimmed(text, F.array(c, out_of_text), 0.4)))
    return rows.select("k", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "value")


HYBRID = [
    ("Jane Citizen mailed jane@x.org", ("private_person", 0, 12), "[REDACTED_NAME] mailed [REDACTED_EMAIL]", False, 2), ("TFN: 999 999 999 for the file", ("account_number", 5, 16), "TFN: [REDACTED_TFN] for the file", True, 1),
    ("Seen at Royal Perth Hospital, Sydney CBD", None, "Seen at [REDACTED_ORGANISATION], [REDACTED_LOCATION]", False, 2), ("nothing to see here", None, "nothing to see here", False, 0),
    ("by jo_smith1 there", ("private_person", 3, 12), "by [REDACTED_USERNAME] there", False, 1),
]


@query(f"""SELECT c_custkey AS document_id, redacted_text, review AS needs_review, n::INT AS pii_count FROM customer
JOIN (VALUES {", ".join(f"({k}, {_quote(t)}, {str(r).lower()}, {n})" for k, (_, _, t, r, n) in enumerate(HYBRID))}) AS v(i, redacted_text, review, n) ON c_custkey % {len(HYBRID)} = i""")
def hybrid_redaction(spark, sf_dir):
    none = F.lit(None).cast(hybrid.CANDIDATES)
    given = [
        none if c is None else F.array(F.struct(F.lit(c[0]).alias("label"), F.lit(c[1]).alias("start"), F.lit(c[2]).alias("end"), F.lit(t[c[1] : c[2]]).alias("value"), F.lit(0.9).alias("score"))).cast(hybrid.CANDIDATES)
        for t, c, *_ in HYBRID
    ]
    docs = _cases(spark, sf_dir, [t for t, *_ in HYBRID]).withColumn("candidates", F.get(F.array(*given), (F.col("doc_id") % len(HYBRID)).cast("int")))
    return hybrid.hybrid_table(docs, gazetteers=KNOWN, style="category").select("document_id", "redacted_text", "needs_review", "pii_count")


@query("""SELECT 'confidence' AS mode, 0.7::DOUBLE AS min_score, 200 AS min_tokens, count(*) FILTER (n >= 200) AS invocations, count(*) FILTER (n < 200) AS skips, count(*) FILTER (n >= 200) / count(*)::DOUBLE AS invoke_rate, count(*) AS documents_processed
FROM (SELECT len(list_filter(regexp_split_to_array(text, '[ \t\n\x0b\f\r]+'), lambda x: x <> '')) AS n FROM documents)""")
def gate_statistics(spark, sf_dir):
    gated = table(spark, sf_dir, "documents").select(R.worth_a_model(F.col("text"), F.array(F.lit(0.5))).alias("gate"))
    return hybrid.gate_stats(gated)
