"""Runs over folders: redact one file, ingest a folder, gate it, and put its evidence together."""

from __future__ import annotations

import json
import os
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import readers
from . import redaction, report


def truthy(raw: str | None, default: bool) -> bool:
    """An environment's text as a switch; unset gives the default, and so does an empty text."""
    return default if raw is None or not raw.strip() else raw.strip().lower() in ("1", "true", "yes", "on")


def setting(env: dict[str, str], name: str, default: Any) -> Any:
    """An environment's value in the type of its default; what can't be read gives the default."""
    raw = env.get(name)
    if isinstance(default, bool):
        return truthy(raw, default)
    try:
        return default if raw is None or not raw.strip() else type(default)(raw)
    except ValueError:
        return default


def run_settings(policy_name: str, env: dict[str, str] | None = None, prefix: str = "QUILLVEIL_", force: bool = False) -> dict[str, Any]:
    """A policy's settings; those that the environment sets win, unless `force`."""
    base = redaction.policy(policy_name)
    if force:
        return base
    given = {k: setting(env or dict(os.environ), prefix + k.upper(), v) for k, v in base.items() if not isinstance(v, list) and k not in ("name", "description")}
    return base | given


def _put(spark: SparkSession, path: str, text: str) -> None:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()


def _get(spark: SparkSession, path: str) -> str | None:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    if fs.getFileStatus(at).isDirectory():
        return "\n".join(r[0] for r in spark.read.text(path).collect())
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def redact_file(spark: SparkSession, path: str, output: str, document_id: str | None = None, policy_name: str = "kg_rag_default", metadata: str | None = None) -> dict[str, Any]:
    """Redact one file into another; returns (and writes, if asked) its manifest row."""
    settings = run_settings(policy_name)
    own = document_id or os.path.splitext(os.path.basename(path))[0]
    docs = readers.read_folder(spark, path).select(F.lit(own).alias("doc_id"), "text")
    row = redaction.redact_table(docs, settings=settings).withColumn("input_path", F.lit(path)).withColumn("output_path", F.lit(output)).persist()
    done = redaction.manifest(row, policy_name).first()
    if done is None:
        raise ValueError(f"{path} has more than {settings['max_text_chars']} characters")
    _put(spark, output, row.first()["redacted_text"])
    row.unpersist()
    out = done.asDict() | {"processed_at": _now()}
    if metadata:
        _put(spark, metadata, json.dumps(out, indent=2, sort_keys=True) + "\n")
    return out


def _now() -> str:
    from datetime import datetime, timezone

    return datetime.now(timezone.utc).isoformat()


def ingest(spark: SparkSession, folder: str, output: str, manifest: str, policy_name: str = "kg_rag_default", prefix: str = "DOC", fail_fast: bool = False) -> dict[str, Any]:
    """Redact every text file under a folder to the same place under another, and write a manifest of JSON lines.

    Files that a policy's size limit keeps out, or that can't be written, are failures; with fail_fast the first of them is an
    error.  Returns the run's summary: FAIL with failures or without documents, else REVIEW or PASS.
    """
    settings = run_settings(policy_name)
    if not _exists(spark, folder):
        return _summary("FAIL", policy_name, 0, 0, [{"input_path": folder, "error": "no such folder or file"}], manifest, output)
    files = readers.with_source_ids(readers.read_folder(spark, folder), prefix)
    docs = files.select(F.struct("source_id", "path", "relative_path").alias("doc_id"), "text")
    # ids, texts and what is written from them come from one table, so a second reading of the folder can't tell another story
    at = f"{manifest.rstrip('/')}.work"
    redaction.redact_table(docs, settings=settings).select("document_id.*", "*").withColumnsRenamed({"document_id": "_doc", "source_id": "document_id", "path": "input_path"}).drop("_doc").write.mode("overwrite").parquet(f"{at}/results")
    results = spark.read.parquet(f"{at}/results")
    readers.write_texts(results, output).write.mode("overwrite").parquet(f"{at}/written")
    written = spark.read.parquet(f"{at}/written")
    late = redaction.oversized(docs, settings).select(F.col("document_id.path").alias("input_path"), "error")
    broken = results.select("document_id", "input_path").join(written.where("error is not null"), "document_id").select("input_path", "error")
    failures = [r.asDict() for r in late.union(broken).orderBy("input_path").limit(1000).collect()]
    if failures and fail_fast:
        raise ValueError(f"{failures[0]['input_path']}: {failures[0]['error']}")
    rows = redaction.manifest(results.join(written.where("error is null").select("document_id", "output_path"), "document_id"), policy_name)
    readers.write_jsonl(rows.withColumn("processed_at", F.lit(_now())), manifest)
    total = rows.agg(F.count("*").alias("n"), F.count_if(F.col("gate_status") == "review").alias("r")).first()
    _drop(spark, at)
    if not total["n"] and not failures:
        failures = [{"input_path": folder, "error": "no text files there"}]
    status = "FAIL" if failures or not total["n"] else "REVIEW" if total["r"] else "PASS"
    return _summary(status, policy_name, total["n"], total["r"], failures, manifest, output)


def _drop(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _summary(status: str, policy_name: str, n: int, review: int, failures: list[dict], manifest: str, output: str) -> dict[str, Any]:
    return {"status": status, "policy": policy_name, "documents_processed": n, "needs_review_documents": review, "failures": failures, "manifest": manifest, "output": output, "exit_code": int(status == "FAIL")}


def gate(spark: SparkSession, folder: str, policy_name: str = "kg_rag_default", prefix: str = "GATE", output: str | None = None) -> dict[str, Any]:
    """The verdict over a folder without writing a redacted text: FAIL, REVIEW or PASS; only PASS has exit code 0."""
    settings = run_settings(policy_name)
    if not _exists(spark, folder):
        out = {"status": "FAIL", "documents_processed": 0, "needs_review_documents": 0, "pii_count_total": 0, "pii_categories": []}
    else:
        docs = readers.with_source_ids(readers.read_folder(spark, folder), prefix).select(F.col("source_id").alias("doc_id"), "text")
        rows = redaction.manifest(redaction.redact_table(docs, texts=False, settings=settings), policy_name)
        out = redaction.gate(rows, redaction.oversized(docs, settings)).first().asDict()
    out |= {"policy": policy_name, "exit_code": int(out["status"] != "PASS")}
    if output:
        _put(spark, output, json.dumps({k: v for k, v in out.items() if k != "exit_code"}, indent=2, sort_keys=True) + "\n")
    return out


def evidence_source(spark: SparkSession, run: str) -> tuple[str, dict[str, Any]]:
    """A run's summary and where it comes from: summary.json, else gate-summary.json, else the manifest summed up again."""
    for name in ("summary.json", "gate-summary.json"):
        if (text := _get(spark, f"{run}/{name}")) is not None:
            return name, json.loads(text)
    at = f"{run}/manifest.jsonl"
    if not _exists(spark, at):
        raise FileNotFoundError(f"nothing to take evidence from under {run}: neither summary.json nor gate-summary.json nor manifest.jsonl")
    rows = readers.read_jsonl(spark, at, "pii_count long, pii_categories array<string>, gate_status string")
    r = rows.agg(
        F.count_if(~F.col("gate_status").eqNullSafe("pass")).alias("failed"), F.count("*").alias("documents_processed"), F.coalesce(F.sum("pii_count"), F.lit(0)).alias("pii_count_total"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("pii_categories")))).alias("pii_categories"),
    ).first()
    return "manifest.jsonl", {"status": "PASS" if not r["failed"] else "FAIL", **r.asDict()}


def evidence(spark: SparkSession, run: str, policy_name: str = "kg_rag_default") -> dict[str, Any]:
    """Write evidence-summary.json and EVIDENCE-PACK.md into a run's folder."""
    source, summary = evidence_source(spark, run)
    pack = {"generated_at": _now(), "run_dir": run, "policy": redaction.policy(policy_name), "summary": summary, "summary_source": source}
    _put(spark, f"{run}/evidence-summary.json", json.dumps(pack, indent=2, sort_keys=True) + "\n")
    _put(spark, f"{run}/EVIDENCE-PACK.md", report.evidence(pack))
    return {"status": "PASS", "evidence": f"{run}/EVIDENCE-PACK.md", "summary": f"{run}/evidence-summary.json"}


def suite(spark: SparkSession, fixtures: DataFrame, documents: DataFrame, labels: DataFrame, profile: str = "full", quick: list[str] | None = None, patterns_only: bool = True) -> DataFrame:
    """Leaks of every fixture of a profile in one plan: fixture, documents, checked, leaks, leak_counts, status.

    fixtures: fixture, required; documents: fixture, document_id, text; labels: fixture, document_id, category, value, valid.
    """
    from ..operators import evaluate

    chosen = evaluate.select_fixtures(fixtures, profile, quick).select("fixture")
    docs = documents.join(chosen, "fixture", "left_semi").select(F.struct("fixture", "document_id").alias("key"), "text")
    results = redaction.redact_table(docs, "key")
    own = labels.join(chosen, "fixture", "left_semi").select(F.struct("fixture", "document_id").alias("document_id"), "category", "value", "valid")
    checked = evaluate.leaks(results, own, patterns_only)
    by_category = checked.groupBy(F.col("document_id.fixture").alias("fixture"), "category").agg(F.count("*").alias("checked"), F.count_if("leaked").alias("leaks"))
    counts = by_category.groupBy("fixture").agg(
        F.sum("checked").alias("checked"), F.sum("leaks").alias("leaks"), F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("leaks") > 0, F.struct("category", "leaks"))))).alias("leak_counts")
    )
    n = documents.groupBy("fixture").agg(F.count("*").alias("documents"))
    zero = F.lit(0).cast("long")
    out = chosen.join(n, "fixture", "left").join(counts, "fixture", "left").select(
        "fixture", F.coalesce("documents", zero).alias("documents"), F.coalesce("checked", zero).alias("checked"), F.coalesce("leaks", zero).alias("leaks"),
        F.coalesce("leak_counts", F.create_map().cast("map<string,bigint>")).alias("leak_counts"),
    )
    return out.withColumn("status", F.when(F.col("leaks") == 0, "PASS").otherwise("FAIL"))
