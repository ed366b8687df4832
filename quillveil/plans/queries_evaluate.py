"""Queries of evaluation: counts, leaks, audit, percentiles, registries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, evaluate
from ..streaming.ingest import service_metrics
from . import redaction, service
from .queries import _EMAIL, _exploded, _labels
from .registry import query, table

_KEY = "0123456789abcdef"
_MAIL_LABELS = f"""(SELECT doc_id, 'email' AS category, unnest(regexp_extract_all(text, '{_EMAIL}')) AS value, true AS valid FROM documents UNION ALL SELECT doc_id, 'name', source, doc_id % 2 = 0 FROM documents)"""


@query(f"SELECT category, count(*) AS n FROM {_MAIL_LABELS} WHERE valid GROUP BY category")
def label_counts(spark, sf_dir):
    return evaluate.label_counts(_labels(spark, sf_dir))


@query(f"SELECT 'email' AS category, sum(len(regexp_extract_all(text, '{_EMAIL}')))::BIGINT AS n FROM documents")
def detected_counts(spark, sf_dir):
    return evaluate.detected_counts(redaction.redact_table(table(spark, sf_dir, "documents"), categories=["email"], texts=False))


@query(f"""WITH r AS (SELECT doc_id, regexp_replace(text, '{_EMAIL}', '[REDACTED_EMAIL]', 'g') AS t FROM documents),
c AS (SELECT doc_id, count(*) AS checked, count(*) FILTER (contains(t, value)) AS leaks FROM {_MAIL_LABELS} JOIN r USING (doc_id) WHERE valid AND value <> '' GROUP BY doc_id)
SELECT d.doc_id AS document_id, coalesce(checked, 0) AS checked, coalesce(leaks, 0) AS leaks FROM documents d LEFT JOIN c USING (doc_id)""")
def leaks_by_document(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    results = redaction.redact_table(docs, style="category", categories=["email"])
    return evaluate.leaks_by_document(docs.select(F.col("doc_id").alias("document_id")), results, _labels(spark, sf_dir))


@query(f"SELECT count(*) AS checked, 0::BIGINT AS leaks FROM {_MAIL_LABELS} WHERE valid AND category <> 'name' AND value <> ''")
def leak_scope_of_patterns(spark, sf_dir):
    results = evaluate.payload(redaction.redact_table(table(spark, sf_dir, "documents"), style="category", categories=["email"]))
    return evaluate.leaks(results, _labels(spark, sf_dir), patterns_only=True).agg(F.count("*").alias("checked"), F.count_if("leaked").alias("leaks"))


@query(f"""SELECT doc_id AS document_id, '{{"document_id":' || doc_id || ',"pii_count":' || len(regexp_extract_all(text, '{_EMAIL}')) || '}}' AS payload FROM documents""")
def sorted_payloads(spark, sf_dir):
    return evaluate.payload(redaction.redact_table(table(spark, sf_dir, "documents"), categories=["email"], texts=False).select("pii_count", "document_id"))


@query("SELECT min(n_chars)::DOUBLE AS min, avg(n_chars)::DOUBLE AS mean, median(n_chars)::DOUBLE AS median, max(n_chars)::DOUBLE AS max, list_sort(list(n_chars))[1 + round_even(0.95 * (count(*) - 1), 0)::BIGINT]::DOUBLE AS p95 FROM documents")
def latency_summary(spark, sf_dir):
    return evaluate.latencies(table(spark, sf_dir, "documents"), "n_chars")


@query("SELECT lang, p::DOUBLE AS p, list_sort(list(n_chars))[1 + round_even(p / 100.0 * (count(*) - 1), 0)::BIGINT] AS value FROM documents, (SELECT unnest([50, 95]) AS p) GROUP BY lang, p")
def percentiles_by_language(spark, sf_dir):
    return evaluate.nearest_rank(table(spark, sf_dir, "documents"), "n_chars", [50, 95], ["lang"]).select("lang", "p", "value")


@query("""WITH b AS (SELECT (doc_id // 25) AS batch, sum(n_chars)::DOUBLE AS latency_ms, count(*) AS documents FROM documents GROUP BY 1),
v AS (SELECT list_sort(list(latency_ms)) AS l, count(*) AS n FROM b)
SELECT 'PARTIAL' AS status, sum(documents)::BIGINT AS documents, (sum(documents) + 1)::BIGINT AS documents_requested, count(*) AS batches_completed, sum(documents) / 10.0 AS docs_per_second, sum(documents) / 10.0 * 86400 AS docs_per_day,
0::BIGINT AS error_count, true AS partial, min(latency_ms) AS min, round(avg(latency_ms), 6) AS mean, median(latency_ms) AS median, max(latency_ms) AS max,
any_value(l[1 + round_even(0.9 * (n - 1), 0)::BIGINT]) AS p90, any_value(l[1 + round_even(0.95 * (n - 1), 0)::BIGINT]) AS p95, any_value(l[1 + round_even(0.99 * (n - 1), 0)::BIGINT]) AS p99 FROM b, v""")
def batch_run_summary(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    batches = docs.groupBy(F.floor(F.col("doc_id") / 25).alias("batch")).agg(F.sum("n_chars").cast("double").alias("latency_ms"), F.count("*").alias("documents"))
    return evaluate.batch_summary(batches, docs.count() + 1, 10.0).withColumn("mean", F.round("mean", 6))


@query("""SELECT CASE WHEN count(*) FILTER (leaks > 0) = 0 THEN 'PASS' ELSE 'FAIL' END AS status, count(*) AS runs, count(*) FILTER (leaks = 0) AS passed, count(*) FILTER (leaks > 0) AS failed, sum(documents)::BIGINT AS documents
FROM (SELECT source, count(*) AS documents, count(*) FILTER (doc_id % 50 = 0) AS leaks FROM documents GROUP BY source)""")
def run_rollup(spark, sf_dir):
    return evaluate.run_rollup(table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("documents"), F.count_if(F.col("doc_id") % 50 == 0).alias("leaks")))


@query("""WITH c AS (SELECT source AS fixture, lang AS category, count(*) AS n FROM documents WHERE doc_id % 2 = 0 GROUP BY 1, 2), m AS (SELECT fixture, to_json(map_from_entries(list(struct_pack(k := category, v := n) ORDER BY category))) AS category_counts FROM c GROUP BY fixture)
SELECT d.source AS fixture, 'scale' AS tier, count(*) AS document_count, coalesce(any_value(m.category_counts), '{}') AS category_counts, true AS required FROM documents d LEFT JOIN m ON m.fixture = d.source GROUP BY d.source""")
def fixture_registry(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumnRenamed("source", "fixture")
    labels = docs.select("fixture", F.col("lang").alias("category"), (F.col("doc_id") % 2 == 0).alias("valid"))
    found = evaluate.registry(docs.select("fixture", F.col("doc_id").alias("document_id")), labels)
    return found.withColumn("tier", F.lit("scale")).withColumn("category_counts", F.to_json("category_counts"))


@query("SELECT DISTINCT source AS fixture FROM documents WHERE right(source, 1) NOT IN ('1', '3', '5')")
def required_fixtures(spark, sf_dir):
    fixtures = table(spark, sf_dir, "documents").select(F.col("source").alias("fixture")).distinct().withColumn("required", F.when(F.right("fixture", F.lit(1)).isin("1", "3", "5"), False))
    return evaluate.select_fixtures(fixtures, "proper").select("fixture")


@query(f"""SELECT source AS fixture, count(DISTINCT doc_id) AS documents, coalesce(sum(n), 0)::BIGINT AS checked, 0::BIGINT AS leaks, 'PASS' AS status FROM (SELECT doc_id, source, len(regexp_extract_all(text, '{_EMAIL}')) AS n FROM documents) GROUP BY source""")
def suite_by_fixture(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("fixture"), F.col("doc_id").alias("document_id"), "text")
    labels = _exploded(spark, sf_dir, "documents", "text", "doc_id", "email").select(F.col("doc_id").alias("document_id"), F.lit("email").alias("category"), "value", F.lit(True).alias("valid")).join(docs.select("fixture", "document_id"), "document_id")
    return service.suite(spark, docs.select("fixture").distinct(), docs, labels).select("fixture", "documents", "checked", "leaks", "status")


def _log(spark, sf_dir):
    kept = redaction.redact_table(table(spark, sf_dir, "documents"), categories=["email"], keep_values=True, texts=False)
    return audit.audit_rows(kept, "run", _KEY)


@query(f"SELECT sum(n)::BIGINT AS line_count, sum(n)::BIGINT AS encrypted_value_count, 0::BIGINT AS plaintext_leak_count, 'PASS' AS verdict FROM (SELECT len(regexp_extract_all(text, '{_EMAIL}')) AS n FROM documents)")
def audit_summary(spark, sf_dir):
    labels = _labels(spark, sf_dir).where("category = 'email'")
    s = evaluate.audit_summary(_log(spark, sf_dir), labels)
    return s.withColumn("verdict", evaluate.audit_verdict(F.lit(0), F.col("plaintext_leak_count"), F.col("encrypted_value_count"), F.col("line_count")))


@query(f"""SELECT category, value, count(*) AS labels FROM (SELECT 'email' AS category, 'email' AS value UNION ALL SELECT 'name', 'regex' UNION ALL SELECT 'name', 'regex' UNION ALL SELECT 'phone', ':1') GROUP BY ALL""")
def audit_plaintext_leaks(spark, sf_dir):
    labels = spark.createDataFrame([("email", "email", True), ("name", "regex", True), ("name", "regex", True), ("name", "nowhere in the log", True), ("phone", ":1", True), ("phone", "~~", True), ("name", "email", False)], "category string, value string, valid boolean")
    return evaluate.audit_leaks(_log(spark, sf_dir).where("document_id is not null"), labels)


@query(f"""SELECT sha256('run|' || doc_id) AS audit_id, value FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_EMAIL}')) AS value FROM documents) WHERE doc_id = (SELECT min(doc_id) FROM documents WHERE regexp_matches(text, '{_EMAIL}'))""")
def reidentified_values(spark, sf_dir):
    log = _log(spark, sf_dir)
    first = table(spark, sf_dir, "documents").where(F.col("text").rlike(_EMAIL)).agg(F.min("doc_id").alias("document_id"))
    own = audit.audit_ids(first, "run").first()
    audit_id = own["audit_id"] if own else ""
    return audit.reidentify(log, audit_id, _KEY).select(F.lit(audit_id).alias("audit_id"), "value")


@query(f"""SELECT doc_id::VARCHAR AS document_id, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_EMAIL}')) AS value FROM documents) WHERE doc_id % 2 = 1 GROUP BY doc_id""")
def purged_log(spark, sf_dir):
    gone = audit.audit_ids(table(spark, sf_dir, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("document_id")), "run")
    return audit.purge(_log(spark, sf_dir), gone).groupBy("document_id").agg(F.count("*").alias("n"))


@query("""SELECT count(*) FILTER (doc_id % 10 <> 0) AS documents_processed, count(*) FILTER (doc_id % 10 = 0) AS errors_total, count(*) FILTER (doc_id % 10 <> 0) AS pii_spans_total, sum(CASE WHEN doc_id % 10 <> 0 THEN n_chars ELSE 0 END)::DOUBLE AS latency_ms_total,
max(CASE WHEN doc_id % 10 <> 0 THEN n_chars END)::DOUBLE AS latency_ms_max, round(sum(CASE WHEN doc_id % 10 <> 0 THEN n_chars ELSE 0 END) / count(*) FILTER (doc_id % 10 <> 0)::DOUBLE, 3) AS latency_ms_mean,
(SELECT to_json(map_from_entries(list(struct_pack(k := lang, v := n) ORDER BY lang))) FROM (SELECT lang, count(*) AS n FROM documents WHERE doc_id % 10 <> 0 GROUP BY lang)) AS categories FROM documents""")
def service_counters(spark, sf_dir):
    requests = table(spark, sf_dir, "documents").select(F.col("n_chars").cast("double").alias("latency_ms"), F.array("lang").alias("categories"), (F.col("doc_id") % 10 == 0).alias("failed"))
    return service_metrics(requests).withColumn("categories", F.to_json("categories"))


@query("""SELECT doc_id::VARCHAR AS document_id, list_sort(list(struct_pack(category := category, value := value))) AS labels FROM (
SELECT doc_id, lang AS category, source AS value FROM documents WHERE doc_id % 3 > 0 UNION ALL SELECT doc_id, 'flat', lang FROM documents WHERE doc_id % 3 < 2) GROUP BY doc_id""")
def labels_of_two_schemas(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id"), F.col("doc_id").cast("string").alias("id"), "lang", "source")
    nested = d.where("doc_id % 3 > 0").select("id", F.array(F.struct(F.col("lang").alias("category"), F.col("source").alias("value"), F.lit(True).alias("valid"))).alias("labels"))
    flat = d.where("doc_id % 3 < 2").select(F.col("id").alias("document_id"), F.lit("flat").alias("category"), F.col("lang").alias("value"))
    return evaluate.labels_by_document(nested, flat).select("document_id", F.transform("labels", lambda x: F.struct(x["category"].alias("category"), x["value"].alias("value"))).alias("labels"))
