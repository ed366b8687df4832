"""The default plan: detect, propagate, validate, merge, number and splice; manifest and gate over it."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import spans as S
from ..operators import resolve
from ..ship import ship

# The policies' settings, and the manifest's required columns.
POLICIES: dict[str, dict[str, Any]] = {
    "kg_rag_default": {
        "description": "High-recall pre-ingestion firewall for KG/RAG pipelines.", "username_mode": "high_recall", "max_text_chars": 200_000, "max_batch_docs": 1000, "max_concurrency": 8,
    },
    "healthcare_high_recall": {
        "description": "Maximum recall profile for clinical and patient data.", "username_mode": "high_recall", "max_text_chars": 200_000, "max_batch_docs": 500, "max_concurrency": 6,
    },
    "legal_review": {
        "description": "Fail-closed legal review profile with audit retention.", "username_mode": "high_recall", "max_text_chars": 300_000, "max_batch_docs": 250, "max_concurrency": 4,
    },
    "logs_low_noise": {
        "description": "Lower-noise log profile. Not safe as the default for KG/RAG ingestion.", "username_mode": "strict", "max_text_chars": 100_000, "max_batch_docs": 2000, "max_concurrency": 12,
    },
}
COMMON = {"fail_on_model_error": True, "audit_enabled": True}
REQUIRED = ["source_id", "redaction_audit_id", "pii_count", "pii_categories", "redaction_policy", "model_used", "gate_status"]
#: windows that a long text is read in: code points, and those that two windows share
CHUNK = (4000, 200)


def policy(name: str, **given) -> dict[str, Any]:
    """Settings of a policy; given ones win."""
    if name not in POLICIES:
        raise ValueError(f"unknown policy {name!r}; known: {', '.join(sorted(POLICIES))}")
    return {"name": name, "required_metadata": REQUIRED, **COMMON, **POLICIES[name], **given}


def policy_table(spark) -> DataFrame:
    """The policies as a table, a row each."""
    rows = [(n, p["description"], p["username_mode"], p["max_text_chars"], p["max_batch_docs"], p["max_concurrency"], REQUIRED) for n, p in sorted(POLICIES.items())]
    return spark.createDataFrame(rows, "name string, description string, username_mode string, max_text_chars int, max_batch_docs int, max_concurrency int, required_metadata array<string>")


def spread(docs: DataFrame) -> DataFrame:
    """docs over as many tasks as the cluster has slots, where the scan gives few (one file of one row group is one task)."""
    if docs.isStreaming:
        return docs
    slots = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(3 * slots) if docs.rdd.getNumPartitions() < 3 * slots else docs


def small_batches(docs: DataFrame) -> None:
    """Arrow batches bounded by bytes too, so that a batch of long texts and their hits fits a worker."""
    conf = docs.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 2000:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2000)


def cut_table(docs: DataFrame, id_col: str, text_col: str, categories: list[str] | None = None, strict: bool = False, *more: str) -> tuple[DataFrame, list[str]]:
    """(document_id, _t, further columns, the cuts of each pattern), and the patterns' categories."""
    ship(docs.sparkSession)
    small_batches(docs)
    base = spread(docs.select(F.col(id_col).alias("document_id"), S.clean(F.col(text_col)).alias("_t"), *more))
    chosen = S.chosen(categories)
    return base.select("document_id", "_t", *more, *[S.cuts(F.col("_t"), p, strict).alias(f"_c{k}") for k, p in chosen]), [p.category for _, p in chosen]


def redact_table(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", style: str = "numbered", categories: list[str] | None = None, strict: bool = False, propagate: bool = True,
    keep_values: bool = False, priority: bool = False, chunk: tuple[int, int] | None = CHUNK, texts: bool = True, settings: dict[str, Any] | None = None,
) -> DataFrame:
    """document_id, redacted_text, pii_count, needs_review, spans of every document.

    Patterns and checks run in the JVM over the scan; the cuts of a document are then
    summed, propagated, merged, numbered and spliced in one linear pass in Arrow
    batches.  The one exchange, of whole rows and only where the scan has fewer tasks than the cluster slots, spreads the texts.
    Values leave the spans unless keep_values is set (for the audit); priority: merge by category priority instead of by union;
    chunk: see `resolve.propagate`; texts: without them redacted_text is null and nothing is spliced.
    settings (of a `policy`): username_mode "strict" sets strict; texts of more than max_text_chars are left out (see `oversized`).
    Null texts are empty and have no spans; repeated rows repeat; an empty table gives no rows; other columns aren't read.
    """
    if style not in ("numbered", "category", "asterisk"):
        raise ValueError(f"unknown placeholder style {style!r}")
    if settings:
        strict = strict or settings["username_mode"] == "strict"
        docs = docs.where(~too_long(text_col, settings["max_text_chars"]))
    table, names = cut_table(docs, id_col, text_col, categories, strict)
    id_type = table.schema["document_id"].dataType.simpleString()
    merged = resolve.by_priority if priority else lambda text, spans: resolve.union(spans)
    return table.mapInArrow(resolve.resolver(names, style, chunk, propagate, keep_values, merged, texts), f"document_id {id_type}, {resolve.OUT}")


def too_long(text_col: str, limit: int):
    return F.coalesce(F.char_length(text_col), F.lit(0)) > limit


def oversized(docs: DataFrame, settings: dict[str, Any], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(document_id, error) of the documents that a policy's size limit keeps out."""
    limit = settings["max_text_chars"]
    return docs.where(too_long(text_col, limit)).select(F.col(id_col).alias("document_id"), F.format_string(f"text has %d characters, more than {limit}", F.char_length(text_col)).alias("error"))


def check_batch(n: int, settings: dict[str, Any]) -> None:
    if n > settings["max_batch_docs"]:
        raise ValueError(f"a batch of {n} documents, more than {settings['max_batch_docs']}")


def manifest(results: DataFrame, policy_name: str, model: str = "regex", run_id: str = "") -> DataFrame:
    """A row per document with its gate status; paths are taken from results where they have them."""
    paths = [c for c in ("input_path", "output_path") if c in results.columns]
    return results.select(
        F.col("document_id").cast("string").alias("source_id"), *paths, F.sha2(F.concat_ws("|", F.lit(run_id or policy_name), F.col("document_id").cast("string")), 256).alias("redaction_audit_id"), "pii_count",
        F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["category"]))).alias("pii_categories"), F.lit(policy_name).alias("redaction_policy"),
        F.lit(model).alias("model_used"), "needs_review", F.when(F.col("needs_review"), "review").otherwise("pass").alias("gate_status"),
    )


def gate(rows: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """One row: FAIL without documents or with failures, REVIEW if any is to be reviewed, else PASS."""
    total = rows.agg(
        F.count("*").alias("documents_processed"), F.count_if(F.col("gate_status") == "review").alias("needs_review_documents"),
        F.coalesce(F.sum("pii_count"), F.lit(0)).alias("pii_count_total"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("pii_categories")))).alias("pii_categories"),
    )
    failed = F.lit(0).cast("long")
    if failures is not None:
        total = total.crossJoin(F.broadcast(failures.agg(F.count("*").alias("failed"))))
        failed = F.col("failed")
    status = F.when((F.col("documents_processed") == 0) | (failed > 0), "FAIL").when(F.col("needs_review_documents") > 0, "REVIEW").otherwise("PASS")
    return total.select(status.alias("status"), "documents_processed", "needs_review_documents", "pii_count_total", "pii_categories")
