import random
import re

import pytest
from pyspark.sql import functions as F

from quillveil.functions import checks
from quillveil.functions import spans as S
from quillveil.functions.patterns import CATEGORIES, PATTERNS
from quillveil.operators import audit, evaluate, merge, redact, resolve
from quillveil.plans import redaction

GOOD = {
    "tfn": ["123 456 782", "876 543 210"], "abn": ["33 051 775 556", "51 824 753 556"], "acn": ["051 775 556", "004 085 616"],
    "medicare": ["2957 20197 1", "2957 20197 1-1", "2123 45670 1"], "bsb_account": ["062-000", "083 000"],
}
BAD = {
    "tfn": ["999 999 999", "000 000 000", "123 456 789"], "abn": ["11 111 111 111", "12 345 678 901"], "acn": ["123 456 789", "000 000 001"],
    "medicare": ["1234 56789 0", "2950 04000 0"], "bsb_account": ["12345", "1234567"],
}


def test_checksums(spark):
    rows = [(c, v, True) for c, vs in GOOD.items() for v in vs] + [(c, v, False) for c, vs in BAD.items() for v in vs]
    df = spark.createDataFrame(rows, "c string, v string, want boolean").withColumn("got", checks.passed(F.col("c"), F.col("v")))
    assert df.where("got is null or got <> want").collect() == []
    assert spark.range(1).select(checks.passed(F.lit("name"), F.lit("x"))).first()[0] is None


TEXT = "Zoë 𝒳 Patient: Mary-Anne O'Connor, mail a.b+c@ex-ample.com.au or 10.0.0.255; ABN33051775556 Patient ID: PT-448812 and MRN HOSP-998271 on 12/03/2024, (02) 9374 4000 www.site.org/x at 12 Long Street, Perth WA 6000"


def test_offsets_and_categories(spark):
    got = spark.createDataFrame([(TEXT,)], "t string").select(F.inline(S.detect(S.clean(F.col("t"))))).collect()
    for s in got:
        assert TEXT[s["start"] : s["end"]] == s["value"]
    found = {(s["category"], s["value"]) for s in got}
    for want in [("name", "Mary-Anne O'Connor"), ("email", "a.b+c@ex-ample.com.au"), ("ip_address", "10.0.0.255"), ("abn", "33051775556"), ("patient_id", "PT-448812"), ("medical_record_number", "HOSP-998271"), ("date", "12/03/2024"), ("phone", "(02) 9374 4000"), ("url", "www.site.org/x")]:
        assert want in found
    assert any(c == "address" for c, _ in found)


# the shortest match of each branch, and others that lack what the other branches have in common
SHORTEST = {
    "abn": ["33051775556"], "tfn": ["12345678"], "acn": ["123456789"], "medicare": ["1234567890"], "bsb_account": ["123456"],
    "patient_id": ["pt id 12345", "Patient no 12345", "PATIENT IDENTIFIER: A-12"], "medical_record_number": ["mrn ABCDE", "Medical record no ABCDE", "HOSPITAL ur ABCDE"],
    "healthcare_identifier": ["ihi 1234567812345678"], "name": ["client:A B", "Next of Kin - A B", "patient #A B"], "passport": ["A1234567"], "driver_licence": ["123456"], "centrelink_crn": ["123456789A"],
    "phone": [
        "+61212341234", "+61412341234", "(02)12341234", "02 12341234", "0412345678", "+1(22)333333", "+1(0)1333333", "+1333 333", "+45 12 34 56 78", "+47 22 33", "+1-22-33",
        "1(22)333333", "(22)333333", "123-123-1234", "1234 1234", "123.123.1234", "012 123 123",
    ],
    "email": ["a@b.cd"], "url": ["http://a", "HTTPS://a", "tps://a", "www.-", "www.1", "WWW.1", "www.é", "a.bc"], "address": ["1 St", "1 a way"],
    "username": ["login:abc", "handle = abc", "@abc", "a.b", "a_b", "a-b", "abcd1", "...a.b...", "...abcd1..."],
    "generic_id": ["id:abc", "ref#abc", "case-abc", "AB:12345", "AB:ABCDE", "123-12-1234", "A 12 12 12 A", "ABCDE1", "1,1,1", "1234567890"],
    "date": ["1/1/11", "1:11", "1a11", "11a11", "half past 1", "1 o'clock", "abc/1", "may/1", "abc 1 11", "1a abc 11", "1 abc abc 1", "May 1 11", "1 May 11"], "ip_address": ["1.1.1.1"],
}


def test_every_blank_digit_and_strict_mode(spark):
    for blank in "\u00a0\u2003\u202f\u3000\x1c\x85\t":
        text = f"ABN 51{blank}824{blank}753{blank}556 TFN 123{blank}456{blank}782 call 0412{blank}345{blank}678"
        got = {(s["category"], s["value"]) for s in spark.createDataFrame([(text,)], "t string").select(F.inline(S.detect(S.clean(F.col("t"))))).collect()}
        for c, v in (("abn", "51 824 753 556"), ("tfn", "123 456 782"), ("phone", "0412 345 678")):
            assert (c, v.replace(" ", blank)) in got, (blank, c)
    arabic = "TFN \u0661\u0662\u0663 \u0664\u0665\u0666 \u0667\u0668\u0662"
    got = spark.createDataFrame([(arabic,)], "t string").select(F.inline(S.validated(S.detect(S.clean(F.col("t")), ["tfn"])))).first()
    assert got["value"] == arabic[4:] and got["validator_passed"]
    users = "username: alice99 and bobby77 then ...carla88... and jo.smith"
    for strict, want in ((False, {"alice99", "bobby77", "carla88", "jo.smith"}), (True, {"alice99", "carla88", "jo.smith"})):
        got = spark.createDataFrame([(users,)], "t string").select(F.inline(S.detect(S.clean(F.col("t")), ["username"], strict))).collect()
        assert {s["value"] for s in got} == want
        out = redaction.redact_table(spark.createDataFrame([(1, users)], "doc_id long, text string"), settings=redaction.policy("logs_low_noise" if strict else "kg_rag_default"), categories=["username"], keep_values=True).first()
        assert {s["value"] for s in out["spans"]} == want


def _python(regex):
    """A Java pattern of ours for Python's re: flags for a group are spelt out, and blanks, digits and word bounds are Unicode's there anyway."""
    from quillveil.functions.patterns import BLANK

    plain = regex.replace(BLANK, r"\s").replace(r"\p{Nd}", r"\d").replace(r"(?U:\b)", r"\b")
    return re.compile(re.sub(r"\[([^]]*)\[?\\s\]?", r"[\1\\s", plain) if "[\\s" in plain else plain.replace("(?U:", "(?:"))


def _by_hand(text):
    """(category, start, end, value) of all hits, by Python's own matcher."""
    from quillveil.functions.patterns import BENIGN_NAME, BENIGN_TOKENS, RESERVED_HOSTS

    out = []
    for p in PATTERNS:
        for m in _python(p.regex.replace("(?U:", "(?:")).finditer(text):
            k = next((k for k in range(2, (m.re.groups or 1) + 1) if m.group(k)), None)
            if k is None:
                continue
            v = m.group(k).strip().rstrip(".,;:)")
            low = v.lower()
            if p.category == "username" and (low in BENIGN_TOKENS or re.match(BENIGN_NAME.replace(r"\p{Nd}", r"\d"), v)) or p.category == "generic_id" and re.fullmatch("[A-Z]{4}[0-9]{4}", v):
                continue
            if p.category == "url" and (low == "localhost" or low.endswith(tuple(RESERVED_HOSTS))):
                continue
            out.append((p.category, m.start(k), m.end(k), m.group(k)))
    return out


def _texts(spark, n=60):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text is not null").orderBy("doc_id").limit(n)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    extra = [TEXT, "Bad TFN: 999 999 999, ok 123 456 782; 062-000.1 PA1234567 jo_smith1 @handle AB:12345 A 12 12 12 A", " ".join(f"u{k}@x{k}.org 12/0{k % 9}/2024 id: ZX-{k}" for k in range(300)), "", "\x01\x02\x03 a@b.co"]
    return rows + [(10**9 + k, t) for k, t in enumerate(extra)]


def test_detection_and_redaction_equal_plain_python(spark):
    """The whole plan against a slow one that shares no code with it but the patterns."""
    rows = _texts(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    hits = {r["doc_id"]: [tuple(x) for x in r["h"]] for r in docs.select("doc_id", F.transform(S.detect(S.clean(F.col("text"))), lambda s: F.struct(s["category"], s["start"], s["end"], s["value"])).alias("h")).collect()}
    got = {r["document_id"]: r for r in redaction.redact_table(docs, keep_values=True).collect()}
    for i, text in rows:
        text = re.sub("[\x01-\x03]", "\ufffd", text)
        want = _by_hand(text)
        assert hits[i] == want, i
        every, seen = [], set()
        for c, a, b, v in want:
            every.append((c, a, b, v))
        for c, a, b, v in want:  # every window is read by itself
            size, step = redaction.CHUNK[0], redaction.CHUNK[0] - redaction.CHUNK[1]
            windows = [0] if len(text) <= size else [w for w in range(0, len(text), step) if w <= a and b <= w + size]
            if windows and (c, v) not in seen:
                seen.add((c, v))
                w = min(min([0] if len(text) <= size else [w for w in range(0, len(text), step) if w <= x and y <= w + size] or [10**9]) for d, x, y, u in want if (d, u) == (c, v))
                every += [(c, m.start(), m.end(), v) for m in re.finditer(re.escape(v), text) if m.start() >= w] if w < 10**9 else []
        merged = []
        for c, a, b, v in sorted(every, key=lambda s: (s[1], s[1] - s[2])):
            ok = _check(c, v)
            s = dict(category=c, start=a, end=b, value=v, ok=ok, review=ok is False)
            if merged and a < merged[-1]["end"]:
                last = merged[-1]
                win = s if b - a > last["end"] - last["start"] or b - a == last["end"] - last["start"] and ok and not last["ok"] else last
                lo, hi = min(a, last["start"]), max(b, last["end"])
                new = dict(win)
                if (lo, hi) != (win["start"], win["end"]):
                    new |= dict(value=None, review=s["review"] or last["review"])
                merged[-1] = new | dict(start=lo, end=hi)
            else:
                merged.append(s)
        assert [(s["category"], s["start"], s["end"], s["value"], s["needs_review"]) for s in got[i]["spans"]] == [(s["category"], s["start"], s["end"], s["value"], s["review"]) for s in merged], i
        numbers, out, at = {}, "", 0
        for s in merged:
            if s["value"] is None:
                p = f"[REDACTED_{s['category'].upper()}]"
            else:
                own = numbers.setdefault(s["category"], [])
                if s["value"] not in own:
                    own.append(s["value"])
                p = f"[REDACTED_{s['category'].upper()}_{own.index(s['value']) + 1:03d}]"
            out += text[at : s["start"]] + p
            at = s["end"]
        assert got[i]["redacted_text"] == out + text[at:], i


def _check(category, value):
    d = [int(c) for c in value if c.isdigit()]
    if category not in ("tfn", "abn", "acn", "medicare", "bsb_account"):
        return None
    if not any(d) and category != "bsb_account":
        return False
    total = lambda w: sum(x * y for x, y in zip(d, w))
    if category == "tfn":
        return len(d) in (8, 9) and total(checks.TFN_9 if len(d) == 9 else checks.TFN_8) % 11 == 0
    if category == "abn":
        return len(d) == 11 and (total(checks.ABN) - 10) % 89 == 0
    if category == "acn":
        return len(d) == 9 and (10 - total(checks.ACN) % 10) % 10 == d[8]
    if category == "medicare":
        return len(d) in (10, 11) and total(checks.MEDICARE) % 10 == d[8]
    return len(d) == 6


def test_many_hits_stay_linear(spark):
    import time

    took = []
    for n in (3000, 12000):
        docs = spark.createDataFrame([(1, " ".join(f"u{k}@x.org" for k in range(n)))], "doc_id long, text string")
        docs.select(F.size(S.detect(S.clean(F.col("text")), ["email"]))).collect()
        began = time.time()
        assert docs.select(F.size(S.detect(S.clean(F.col("text")), ["email"]))).first()[0] == n
        took.append(time.time() - began)
    assert took[1] < 10 * took[0] + 1


def test_prefilters_are_necessary(spark):
    assert set(SHORTEST) == set(CATEGORIES)
    for p in PATTERNS:
        df = spark.createDataFrame([(t,) for t in SHORTEST[p.category]], "t string")
        got = df.select("t", F.col("t").rlike(p.regex).alias("match"), F.col("t").rlike(p.needs).alias("passes"), F.size(S.hits(F.col("t"), p)).alias("n")).collect()
        assert [r["t"] for r in got if not (r["match"] and r["passes"] and r["n"])] == [], p.category


@pytest.mark.parametrize("text", [None, "", "no hits here", "\x01\x02"])
def test_no_hits(spark, text):
    assert spark.createDataFrame([(text,)], "t string").select(F.size(S.detect(S.clean(F.col("t")), ["email", "ip_address", "tfn"]))).first()[0] == 0


def test_benign(spark):
    rows = [("username", "alpha123", True), ("username", "retry_limit", True), ("username", "jo.smith1", False), ("url", "x.test.", True), ("generic_id", "ABCD1234", True), ("generic_id", "AB123456", False)]
    df = spark.createDataFrame(rows, "c string, v string, want boolean")
    assert df.where(S.benign(F.col("c"), F.col("v")) != F.col("want")).collect() == []


def _spans(rng, n):
    out = []
    for k in range(n):
        a = rng.randrange(40)
        out.append(dict(category=rng.choice(CATEGORIES[:4]), start=a, end=a + rng.randrange(1, 9), value="v", confidence=1.0, validator_passed=rng.choice([None, True, False]), needs_review=rng.random() < 0.3, seq=k))
    return out


def test_union_merge_covers_and_agrees(spark):
    rng = random.Random(3)
    groups = [(k, _spans(rng, rng.randrange(12))) for k in range(80)]
    df = spark.createDataFrame(groups, f"k int, s array<{S.SPAN}>")
    got = {r["k"]: [x.asDict() for x in r["m"]] for r in df.select("k", merge.union_merge(F.col("s")).alias("m")).collect()}
    for k, spans in groups:
        plain = [resolve.Span(*(s[f] for f in resolve.Span._fields)) for s in spans]
        assert [{f: v for f, v in s.items() if f != "seq"} for s in got[k]] == [s._asdict() for s in resolve.union(plain)]
        covered = {p for s in spans for p in range(s["start"], s["end"])}
        assert {p for s in got[k] for p in range(s["start"], s["end"])} == covered
        assert all(a["end"] <= b["start"] for a, b in zip(got[k], got[k][1:]))


def test_placeholders_and_segments(spark):
    text = "a@b.co then c@d.co then a@b.co!"
    base = spark.createDataFrame([(text,)], "t string").withColumn("s", merge.union_merge(S.detect(F.col("t"), ["email"])))
    p = base.withColumn("p", redact.with_placeholders(F.col("s")))
    r = p.select(redact.splice(F.col("t"), F.col("p")), F.array_join(F.transform(redact.segments(F.col("t"), F.col("s")), lambda x: x["text"]), "")).first()
    assert r[0] == "[REDACTED_EMAIL_001] then [REDACTED_EMAIL_002] then [REDACTED_EMAIL_001]!" and r[1] == text
    with pytest.raises(ValueError):
        redact.with_placeholders(F.col("s"), "other")


def test_plan_end_to_end(spark):
    docs = spark.createDataFrame([(1, "Bad TFN: 999 999 999 and jane@x.org, jane@x.org"), (2, None), (3, "clean")], "doc_id long, text string")
    rows = {r["document_id"]: r for r in redaction.redact_table(docs).collect()}
    assert "999" not in rows[1]["redacted_text"] and rows[1]["needs_review"]
    assert rows[1]["redacted_text"].count("[REDACTED_EMAIL_001]") == 2
    assert all(s["value"] is None for s in rows[1]["spans"]) and rows[2]["pii_count"] == 0 and rows[3]["redacted_text"] == "clean"
    gate = redaction.gate(redaction.manifest(redaction.redact_table(docs), "kg_rag_default")).first()
    assert gate["status"] == "REVIEW" and gate["documents_processed"] == 3
    assert redaction.gate(redaction.manifest(redaction.redact_table(docs.limit(0)), "x")).first()["status"] == "FAIL"


def test_chunks_and_occurrences(spark):
    t = spark.createDataFrame([("abcdefghij",), ("",), ("abc",)], "t string")
    got = [[tuple(x) for x in r[0]] for r in t.select(S.chunks(F.col("t"), 4, 1)).collect()]
    assert got == [[("abcd", 0), ("defg", 3), ("ghij", 6), ("j", 9)], [("", 0)], [("abc", 0)]]
    with pytest.raises(ValueError):
        S.chunks(F.col("t"), 4, 4)
    assert spark.createDataFrame([("aaXaaaX",)], "t string").select(S.occurrences(F.col("t"), F.lit("aa"))).first()[0] == [0, 3]


def test_audit_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(1, "mail a@b.org")], "doc_id long, text string")
    key = "0123456789abcdef"
    log = audit.audit_rows(redaction.redact_table(docs, keep_values=True), "run", key)
    row = log.first()
    assert row["span_start"] == -1 and "a@b.org" not in str(row.asDict())
    assert audit.reidentify(log, row["audit_id"], key).first()["value"] == "a@b.org"
    assert audit.purge(log, log.select("audit_id")).count() == 0
    with pytest.raises(RuntimeError):
        audit.reidentify(log, row["audit_id"], None)
    assert audit.audit_rows(redaction.redact_table(docs), "run", key, enabled=False).count() == 0 and audit.audit_ids(redaction.redact_table(docs), "run").first()["audit_id"] == row["audit_id"]
    log.write.mode("overwrite").json(str(tmp_path / "log"))
    audit.append(log, str(tmp_path / "log"))
    read = spark.read.text(str(tmp_path / "log"))
    assert read.count() == 2 and audit.reidentify_lines(read, row["audit_id"], key).first()["value"] == "a@b.org"
    with pytest.raises(Exception, match="can't be read"):
        audit.reidentify_lines(read.union(spark.createDataFrame([("{oops",)], "value string")), row["audit_id"], key).collect()
    lines = spark.createDataFrame([('{"audit_id":"x1"}',), ("broken x1",), ("brokenx1y",), ("broken",), ('{"audit_id":"y"}',), (None,)], "value string")
    assert {r[0] for r in audit.purge_lines(lines, spark.createDataFrame([("x1",)], "audit_id string")).collect()} == {"broken", '{"audit_id":"y"}', None}


def test_percentiles(spark):
    for n in (1, 2, 7, 20):
        vals = list(range(n))
        got = {r["p"]: r["value"] for r in evaluate.nearest_rank(spark.createDataFrame([(v,) for v in vals], "x long"), "x", [50, 90, 99]).collect()}
        assert got == {float(p): vals[round(p / 100 * (n - 1))] for p in (50, 90, 99)}


def test_stream_equals_batch(spark, tmp_path):
    from quillveil.streaming.ingest import read_stream, redact_stream

    docs = spark.createDataFrame([(k, f"mail u{k}@x.org") for k in range(5)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    redact_stream(read_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    want = redaction.redact_table(docs).select("document_id", "redacted_text")
    assert spark.read.parquet(str(tmp_path / "out")).select("document_id", "redacted_text").exceptAll(want).count() == 0


def _span(c, a, b, ok=None, review=False, confidence=1.0):
    return resolve.Span(c, a, b, None, confidence, ok, review)


def test_priority_merge():
    text = "062-000. 999999999 PA1234567"

    def got(*spans):
        return [(s.category, s.start, s.end, s.needs_review) for s in resolve.by_priority(text, list(spans))]

    # a passed check of a regulated category beats a generic span that has only punctuation beyond it, in either order
    for pair in ([_span("generic_id", 0, 8), _span("bsb_account", 0, 7, True)], [_span("bsb_account", 0, 7, True), _span("generic_id", 0, 8)]):
        assert got(*pair) == [("bsb_account", 0, 7, False)]
    assert got(_span("generic_id", 9, 18), _span("bsb_account", 9, 15, True)) == [("generic_id", 9, 18, False)]
    # on one range: passed, then regulated, then specific; the loser's need of review goes with it
    assert got(_span("tfn", 9, 18, False, True), _span("acn", 9, 18, True)) == [("acn", 9, 18, False)]
    assert got(_span("username", 19, 28), _span("passport", 19, 28), _span("passport", 19, 28, None, True)) == [("passport", 19, 28, True)]
    assert got(_span("name", 19, 28), _span("username", 19, 28)) == [("username", 19, 28, False)]
    assert got(_span("date", 19, 28), _span("email", 19, 28)) == [("date", 19, 28, False)]
    # elsewhere the longer one, then the passed one, then the earlier; the need of review passes on
    assert got(_span("date", 9, 14, None, True), _span("email", 12, 18)) == [("email", 12, 18, True)]
    assert got(_span("date", 9, 14), _span("acn", 12, 17, True)) == [("acn", 12, 17, False)]
    assert got(_span("date", 9, 14), _span("email", 12, 17)) == [("date", 9, 14, False)]
    assert got(_span("date", 0, 3), _span("email", 3, 7)) == [("date", 0, 3, False), ("email", 3, 7, False)]
    kept = resolve.by_priority(text, [_span("date", 9, 14), _span("email", 12, 18)], keep_cover=True)
    assert [(s.category, s.start, s.end, s.value) for s in kept] == [("email", 9, 18, None)]
    one = resolve.one_of_each([_span("tfn", 0, 3), _span("date", 0, 3), _span("tfn", 0, 3, False, True, 0.5), _span("tfn", 0, 3, True, False, 0.9)])
    assert one == [_span("tfn", 0, 3, False, True, 0.5), _span("date", 0, 3)] and resolve.by_priority("", []) == []


def test_gate_and_labels(spark):
    from quillveil.functions import resolve_category as R

    one = spark.range(1)
    got = one.select(R.worth_a_model(F.lit("the patient slept"), F.lit(None).cast("array<double>")).alias("a"), R.worth_a_model(F.lit("x"), F.array(F.lit(0.1), F.lit(0.2))).alias("b"), R.worth_a_model(F.lit(""), F.array(F.lit(0.1))).alias("c"), R.worth_a_model(F.lit("x"), F.array(F.lit(0.1)), "never").alias("d")).first()
    assert [got[k]["reason"] for k in "abcd"] == ["narrative_cue", "openai_low_conf=2<0.70", "skip(tokens=0,spans=1)", "mode=never"]
    rows = [("MRN- 1234567", 5, "1234567", "medical_record_number"), ("TFN: 123456789", 5, "123456789", "tfn"), ("TFN, 123456789", 5, "123456789", None), ("Passport no PA1234567", 12, "PA1234567", "passport")]
    df = spark.createDataFrame(rows, "t string, s int, v string, want string")
    assert [r[0] for r in df.select(R.label_before(F.col("t"), F.col("s"), F.col("v"))).collect()] == [r[3] for r in rows]


def test_shape_counts_equal_sql(spark, tmp_path):
    import duckdb

    from quillveil.plans import queries

    texts = [
        # words of other letters go on behind "st", the digits of other scripts are none, and RE2 knows two more letters without case
        "5433 stß über", "0525 stä", "214 geieein. Stää", "12 High Street", "12 \u017ft Johns", "7 Old Trac\u212a", "7 Straße 9 éSt", "\u0661\u0662\u0663 \u0664\u0665\u0666 \u0667\u0668\u0662", "123 456 782\u0663",
        "ABN 51\u3000824 753-556 \x02123\x03 \x02456\x03", "é1.2.3.4 and 1.2.3.4é", "MRN: ABCDE\u017f", "ho\u017fpital number ABCDE", "cu\u017ftomer: Jo Smith", "cu\u017ftomer: Jo Smithé",
        # bounds of the word runs: numbers that are no digits, marks, connectors, a letter newer than JDK 17, a letter beyond U+FFFF
        "PA1234567\u00b2", "PA1234567\u0301", "PA1234567\u203f", "\u0870PA1234567", "\U00031350PA1234567", "\U0001d400123456789A", "\U0001fae0PA1234567",
        # e-mail addresses without bounds, one behind the other
        "_a@b.com %c@d.org", "a@b.com1", "a@b.com1x@c.de", "a@b@c.de", "a.b_@c.de", "a@b.co_m@c.de", "@x.yy", "a.b.c+d@e-f.gh.ij", None, "",
    ]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con, files = duckdb.connect(), f"read_parquet('{tmp_path}/documents.parquet/*.parquet')"
    con.execute(f"CREATE VIEW documents AS FROM {files}")
    want = con.execute(queries.ORACLE["shape_counts"]).fetchall()
    assert sorted(tuple(r) for r in queries.shape_counts(spark, str(tmp_path)).collect()) == sorted(want)
    # and text by text
    ours = [queries._as_sql(p) for p in PATTERNS if p.category in queries._SHAPED]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", S.clean(F.col("text")).alias("t"))
    got = df.select("doc_id", *[F.size(S.hits(F.col("t"), p)).alias(p.category) for p in ours]).collect()
    for r in got:
        con.execute(f"CREATE OR REPLACE VIEW documents AS FROM {files} WHERE doc_id = {r['doc_id']}")
        assert {p.category: r[p.category] for p in ours if r[p.category]} == dict(con.execute(queries.ORACLE["shape_counts"]).fetchall()), texts[r["doc_id"]]
