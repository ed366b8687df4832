import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quillveil.functions import checks
from quillveil.operators import evaluate, memorisation, ranks
from quillveil.plans import redaction, report, service
from quillveil.sources import converters, readers, synthetic
from quillveil.streaming import ingest


def labels_of(df):
    return {r["id"]: [(x["category"], x["value"], x["valid"]) for x in r["labels"]] for r in df.collect()}


def test_readers(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text('{"id":"a","text":"x"}\n\n  \n{"id":"b"}\n')
    assert [(r["id"], r["text"]) for r in readers.read_jsonl(spark, str(tmp_path / "d.jsonl")).collect()] == [("a", "x"), ("b", None)]
    (tmp_path / "l.jsonl").write_text('{"id":"a","labels":[{"category":"name","value":"v","valid":true},{"category":"tfn","value":"w"}]}\n{"id":"b","labels":[]}\n')
    assert [tuple(r) for r in readers.read_labels(spark, str(tmp_path / "l.jsonl")).collect()] == [("a", "name", "v", True), ("a", "tfn", "w", None)]
    (tmp_path / "a.json").write_text('[{"k": 1},\n{"k": 2}]')
    assert [r[0] for r in readers.read_json_array(spark, str(tmp_path / "a.json"), "k int").collect()] == [1, 2]
    d = tmp_path / "docs" / "sub"
    d.mkdir(parents=True)
    (d / "b.TXT").write_bytes(b"ok \xff")
    (d.parent / "a.md").write_text("one")
    (d / "c.bin").write_bytes(b"no")
    got = readers.with_source_ids(readers.read_folder(spark, str(tmp_path / "docs")), "DOC").orderBy("source_id").collect()
    assert [(r["source_id"], r["relative_path"], r["text"]) for r in got] == [("DOC-000001", "a.md", "one"), ("DOC-000002", "sub/b.TXT", "ok �")]
    assert [r["relative_path"] for r in readers.read_folder(spark, str(d / "c.bin")).collect()] == ["c.bin"]
    head = ["WARC/1.0"] + [f"h{k}" for k in range(1, 10)]
    record = lambda lang, *body: [*head[:7], f"WARC-Identified-Content-Language: {lang}", *head[8:], *body]
    (tmp_path / "x.wet").write_text("\n".join([*record("eng", "first", "more"), *record("deu", "nein"), *record("eng", "second"), *record("eng", "last")]) + "\n")
    assert [r["text"] for r in readers.read_wet(spark, str(tmp_path / "x.wet")).orderBy("position").collect()] == ["first\nmore\n", "second\n"]


def test_converters(spark, tmp_path):
    tokens = [{"document": 1, "full_text": "Ann Lee, x@y.z", "tokens": ["Ann", "Lee", ",", "x@y.z", "Bob", "Jo"], "trailing_whitespace": [True, False, True, True, True, False], "labels": ["B-NAME_STUDENT", "I-NAME_STUDENT", "O", "B-EMAIL", "B-NAME_STUDENT", "B-NAME_STUDENT"]},
              {"document": 2, "full_text": "none", "tokens": ["none"], "trailing_whitespace": [False], "labels": ["B-WHAT"]}]
    (tmp_path / "t.json").write_text(json.dumps(tokens))
    got = converters.convert(spark, {"kind": "token_json", "path": str(tmp_path / "t.json")})
    assert labels_of(got) == {"kaggle-1": [("name", "Ann Lee", True), ("email", "x@y.z", True), ("name", "Bob", True), ("name", "Jo", True)]}
    rec = spark.createDataFrame([(r["document"], r["full_text"], r["tokens"], r["trailing_whitespace"], r["labels"]) for r in tokens], "document long, full_text string, tokens array<string>, trailing_whitespace array<boolean>, labels array<string>")
    assert labels_of(converters.convert_tokens(rec))["kaggle-2"] == []
    (tmp_path / "m.jsonl").write_text("\n".join(json.dumps(x) for x in [
        {"id": 1, "source_text": "t", "privacy_mask": [{"label": "EMAIL", "value": "a@b"}, {"label": "EMAIL", "value": "a@b"}, {"label": "CITY", "value": ""}, {"label": "nope", "value": "x"}]}, {"id": 2, "source_text": "u", "privacy_mask": []}]))
    assert labels_of(converters.convert(spark, {"kind": "masked_jsonl", "path": str(tmp_path / "m.jsonl")})) == {"ai4privacy-1": [("email", "a@b", False)]}
    spark.createDataFrame([("u1", "t", "[{'entity': 'Jo', 'types': ['zzz', 'person']}, {'entity': '12', 'types': []}]"), ("u2", "t", "[]")], "uid string, text string, entities string").write.parquet(str(tmp_path / "g"))
    assert labels_of(converters.convert(spark, {"kind": "literal_parquet", "path": str(tmp_path / "g")})) == {"gretel-u1": [("name", "Jo", True)]}
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("readme.md", "x")
        z.writestr("d/x.csv", 'document,text,name,email,extra\n7,"hello, you", Ann ,,q\n,"two\nlines",,b@c.d,q\n')
    got = converters.convert(spark, {"kind": "csv_zip", "path": str(tmp_path / "c.zip")})
    assert labels_of(got) == {"usercsv-7": [("name", "Ann", True)], "usercsv-2": [("email", "b@c.d", True)]} and {r["text"] for r in got.collect()} == {"hello, you", "two\nlines"}
    lines = [{"uid": 1, "language": "en", "source_text": "s", "privacy_mask": [{"label": "email", "value": "a@b.c"}]}, {"uid": 2, "language": "de", "source_text": "s", "privacy_mask": [{"label": "EMAIL", "value": "x@y.z"}]},
             {"uid": 3, "language": "en", "source_text": "s", "privacy_mask": "[{'label': 'TIME', 'value': '1:00'}]"}]
    with zipfile.ZipFile(tmp_path / "o.zip", "w") as z:
        z.writestr("data/train.jsonl", "\n".join(map(json.dumps, lines)) + "\n\n")
    spec = {"id": "o", "kind": "masked_zip", "path": str(tmp_path / "o.zip"), "entry": "data\\train.jsonl", "languages": "en"}
    assert labels_of(converters.convert(spark, spec)) == {"useropenpii-1": [("email", "a@b.c", True)], "useropenpii-3": [("date", "1:00", True)]}
    every = converters.convert_all(spark, [spec, {"id": "c", "kind": "csv_zip", "path": str(tmp_path / "c.zip")}])
    assert converters.flat_labels(every).groupBy("fixture").count().count() == 2
    with pytest.raises(ValueError):
        converters.convert(spark, {"kind": "?", "path": ""})


def test_synthetic(spark):
    for profile in synthetic.PROFILES:
        rows = synthetic.corpus(spark, 60, profile).collect()
        assert all(x["value"] in r["text"] for r in rows for x in r["labels"]) and len({r["id"] for r in rows}) == 60
        if profile == "negative":
            assert not any(r["labels"] for r in rows)
        else:
            bad = [x for r in rows for x in r["labels"] if not x["valid"]]
            assert 0 < len(bad) < 30 and all(x["category"] == "tfn" for x in bad)
    assert synthetic.corpus(spark, 5).exceptAll(synthetic.corpus(spark, 5).repartition(3)).count() == 0
    with pytest.raises(ValueError):
        synthetic.corpus(spark, 1, "what")
    notes = synthetic.medical_notes(spark, 25)
    medicare = notes.select(F.inline("labels")).where("category = 'medicare'")
    assert notes.select("template").distinct().count() == 5 and medicare.where(~checks.medicare(F.col("value"))).count() == 0
    # what the generator labels as valid is what redaction takes out
    docs = synthetic.corpus(spark, 40, "government").unionByName(synthetic.corpus(spark, 40, "mixed"))
    results = redaction.redact_table(docs, "id")
    labels = docs.select(F.col("id").alias("document_id"), F.inline("labels"))
    leaked = evaluate.leaks(results, labels, patterns_only=True).where("leaked").select("category").distinct().collect()
    assert {r[0] for r in leaked} <= {"driver_licence", "date_of_birth"}


def folder(tmp_path, name, files):
    d = tmp_path / name
    for f, t in files.items():
        (d / f).parent.mkdir(parents=True, exist_ok=True)
        (d / f).write_text(t)
    return str(d)


def test_ingest_gate_evidence(spark, tmp_path):
    ok = folder(tmp_path, "ok", {"a.txt": "mail a@b.org", "sub/b.md": "nothing"})
    got = service.ingest(spark, ok, str(tmp_path / "out"), str(tmp_path / "run" / "manifest.jsonl"))
    assert (got["status"], got["documents_processed"], got["exit_code"]) == ("PASS", 2, 0)
    assert (tmp_path / "out" / "a.txt").read_text() == "mail [REDACTED_EMAIL_001]" and (tmp_path / "out" / "sub" / "b.md").read_text() == "nothing"
    rows = [json.loads(x) for x in "".join(p.read_text() for p in sorted((tmp_path / "run" / "manifest.jsonl").glob("part-*"))).splitlines()]
    assert {r["source_id"] for r in rows} == {"DOC-000001", "DOC-000002"} and all(list(r) == sorted(r) and set(redaction.REQUIRED) <= set(r) for r in rows)
    review = folder(tmp_path, "review", {"a.txt": "TFN 999 999 999"})
    assert service.ingest(spark, review, str(tmp_path / "o2"), str(tmp_path / "m2"))["exit_code"] == 0
    assert [service.gate(spark, d)["status"] for d in (ok, review, str(tmp_path / "nowhere"))] == ["PASS", "REVIEW", "FAIL"]
    gated = service.gate(spark, review, output=str(tmp_path / "g" / "gate-summary.json"))
    assert gated["exit_code"] == 1 and json.loads((tmp_path / "g" / "gate-summary.json").read_text())["needs_review_documents"] == 1
    long = folder(tmp_path, "long", {"a.txt": "x " * 60_000, "b.txt": "short"})
    late = service.ingest(spark, long, str(tmp_path / "o3"), str(tmp_path / "m3"), "logs_low_noise")
    assert late["status"] == "FAIL" and late["documents_processed"] == 1 and "more than 100000" in late["failures"][0]["error"] and service.gate(spark, long, "logs_low_noise")["status"] == "FAIL"
    with pytest.raises(ValueError):
        service.ingest(spark, long, str(tmp_path / "o4"), str(tmp_path / "m4"), "logs_low_noise", fail_fast=True)
    assert service.ingest(spark, str(tmp_path / "no"), str(tmp_path / "o5"), str(tmp_path / "m5"))["status"] == "FAIL"
    (tmp_path / "empty").mkdir()
    assert service.ingest(spark, str(tmp_path / "empty"), str(tmp_path / "o6"), str(tmp_path / "m6"))["status"] == "FAIL"
    pack = service.evidence(spark, str(tmp_path / "run"))
    assert pack["status"] == "PASS" and "manifest.jsonl" in (tmp_path / "run" / "EVIDENCE-PACK.md").read_text()
    assert service.evidence_source(spark, str(tmp_path / "g"))[0] == "gate-summary.json"
    (tmp_path / "g" / "summary.json").write_text('{"status": "PASS"}')
    assert service.evidence_source(spark, str(tmp_path / "g")) == ("summary.json", {"status": "PASS"})
    with pytest.raises(FileNotFoundError):
        service.evidence_source(spark, str(tmp_path / "empty"))
    one = service.redact_file(spark, f"{ok}/a.txt", str(tmp_path / "one.txt"), metadata=str(tmp_path / "one.json"))
    assert one["source_id"] == "a" and (tmp_path / "one.txt").read_text() == "mail [REDACTED_EMAIL_001]" and json.loads((tmp_path / "one.json").read_text())["gate_status"] == "pass"


def test_settings():
    assert service.truthy("On", False) and not service.truthy("no", True) and service.truthy(None, True) and service.truthy(" ", True)
    assert service.setting({"A": "7"}, "A", 1) == 7 and service.setting({"A": "x"}, "A", 1) == 1 and service.setting({"A": "0.5"}, "A", 1.0) == 0.5 and service.setting({}, "A", "d") == "d"
    env = {"QUILLVEIL_USERNAME_MODE": "strict", "QUILLVEIL_MAX_TEXT_CHARS": "10"}
    assert service.run_settings("kg_rag_default", env)["max_text_chars"] == 10 and service.run_settings("kg_rag_default", env, force=True)["username_mode"] == "high_recall"
    with pytest.raises(ValueError):
        redaction.policy("what")
    with pytest.raises(ValueError):
        redaction.check_batch(2001, redaction.policy("logs_low_noise"))
    redaction.check_batch(2000, redaction.policy("logs_low_noise"))


def test_evaluation(spark):
    docs = spark.createDataFrame([(1, "a@b.org"), (2, "none"), (3, "x")], "doc_id long, text string")
    results = redaction.redact_table(docs)
    labels = spark.createDataFrame([(1, "email", "a@b.org", True), (2, "name", "none", None), (2, "tfn", "none", False), (9, "email", "q", True), (3, "email", "", True)], "document_id long, category string, value string, valid boolean")
    assert {(r["document_id"], r["found"], r["leaked"]) for r in evaluate.leaks(results, labels).collect()} == {(1, True, False), (2, True, True), (9, False, False)}
    assert {tuple(r) for r in evaluate.leaks_by_document(docs.withColumnRenamed("doc_id", "document_id"), results, labels).collect()} == {(1, 1, 0), (2, 1, 1), (3, 0, 0)}
    none = spark.createDataFrame([], "batch long, latency_ms double, documents long")
    empty = evaluate.batch_summary(none, 0, 0.0).first()
    assert (empty["status"], empty["p99"], empty["docs_per_second"], empty["partial"]) == ("OK", 0.0, 0.0, False)
    verdicts = spark.createDataFrame([(0, 0, 1, 1), (0, 0, 0, 0), (0, 0, 0, 1), (1, 0, 1, 1), (0, 1, 1, 1)], "a int, b int, c int, d int").select(evaluate.audit_verdict(*map(F.col, "abcd")))
    assert [r[0] for r in verdicts.collect()] == ["PASS", "PASS", "FAIL", "FAIL", "FAIL"]
    fixtures = spark.createDataFrame([("a", None), ("b", False)], "fixture string, required boolean")
    assert [evaluate.select_fixtures(fixtures, p, ["b"]).count() for p in ("quick", "proper", "full")] == [1, 1, 2]
    ranked = ranks.ranked(spark.range(100).withColumn("g", F.col("id") % 3), ["id"], groups=["g"]).collect()
    assert all(r["place"] == r["id"] // 3 for r in ranked) and ranks.first_rows(spark.range(5), ["id"], 0).count() == 5
    with pytest.raises(ValueError):
        ranks.batches(spark.range(5), ["id"], 0)


def test_memorisation(spark):
    import zlib

    rows = [("aaaa" * 50, 2.0, 3.0, 4.0), ("the quick brown fox", 20.0, 30.0, 25.0), (None, 3.0, 3.0, 3.0), ("one", 1.0, 2.0, 2.0)]
    got = {r["text"]: r for r in memorisation.scored(spark.createDataFrame(rows, "text string, xl double, small double, lower double")).collect()}
    assert got["aaaa" * 50]["zlib"] == len(zlib.compress(b"aaaa" * 50)) and got[None]["zlib"] == len(zlib.compress(b""))
    best = memorisation.best(spark.createDataFrame(rows, "text string, xl double, small double, lower double"), 2).collect()
    assert {r["metric"] for r in best} == set(memorisation.METRICS) and len(best) == 8 and got["one"]["by_zlib"] is None
    assert spark.range(1).select(memorisation.perplexity(F.lit(0.0))).first()[0] == 1.0


def test_reports():
    text = report.benchmark({"status": "OK", "total_seconds": 1.0, "docs_per_second": 5.0, "latency_ms": {"p95": 2.0}, "detected_counts": {"email": 3}, "leak_counts": {"name": 1}, "leak_count_total": 1})
    assert "- email: 3" in text and "- name: 1" in text and "p95: 2.0000 ms" in text
    assert "## Sample 1: d" in report.review_pack([{"document_id": "d", "redacted_text": "t", "detected": [], "expected": []}])
    assert "| `x` | `PASS` | 3 docs, 0 failed |" in report.production_gate({"status": "PASS", "checks": [{"name": "x", "status": "PASS", "documents": 3}]})


def test_streams(spark, tmp_path):
    folder(tmp_path, "drop", {"a.txt": "mail a@b.org", "b.txt": "TFN 999 999 999"})
    seen = []
    q = ingest.redact_batches(ingest.read_folder_stream(spark, str(tmp_path / "drop"), 1), str(tmp_path / "ck"), lambda df, n: seen.append((n, df.count())))
    q.awaitTermination()
    assert sum(n for _, n in seen) == 2
    q = ingest.redact_batches(ingest.read_folder_stream(spark, str(tmp_path / "drop"), 1), str(tmp_path / "ck"), lambda df, n: seen.append((n, df.count())))
    q.awaitTermination()
    assert sum(n for _, n in seen) == 2
    docs = spark.createDataFrame([(1, "a@b.org c@d.org"), (2, "TFN 999 999 999")], "doc_id long, text string")
    out, counters = ingest.observed(redaction.redact_table(docs))
    out.collect()
    assert counters.get == {"documents_processed": 2, "pii_spans_total": 3, "needs_review_documents": 1}
    timed = redaction.redact_table(docs).withColumn("processed_at", F.to_timestamp(F.lit("2024-01-01 00:00:30")))
    rates = {r["category"]: r["spans"] for r in ingest.rate_by_window(timed).collect()}
    assert rates["email"] == 2
    failed = spark.createDataFrame([(1.0, ["a"], False), (9.0, ["a", "b"], True)], "latency_ms double, categories array<string>, failed boolean")
    m = ingest.service_metrics(failed).first()
    assert (m["documents_processed"], m["errors_total"], m["pii_spans_total"], m["latency_ms_max"], m["categories"]) == (1, 1, 1, 1.0, {"a": 1})
    assert ingest.service_metrics(failed.limit(0)).first()["latency_ms_mean"] == 0.0


def test_suite(spark):
    docs = spark.createDataFrame([("f1", "a", "mail a@b.org"), ("f2", "a", "plain secret"), ("f3", "z", "x")], "fixture string, document_id string, text string")
    labels = spark.createDataFrame([("f1", "a", "email", "a@b.org", True), ("f2", "a", "generic_id", "secret", True)], "fixture string, document_id string, category string, value string, valid boolean")
    fixtures = spark.createDataFrame([("f1", True), ("f2", True), ("f3", False)], "fixture string, required boolean")
    got = {r["fixture"]: (r["documents"], r["checked"], r["leaks"], r["status"]) for r in service.suite(spark, fixtures, docs, labels, "proper").collect()}
    assert got == {"f1": (1, 1, 0, "PASS"), "f2": (1, 1, 1, "FAIL")}
    assert evaluate.run_rollup(service.suite(spark, fixtures, docs, labels)).first()["status"] == "FAIL"
