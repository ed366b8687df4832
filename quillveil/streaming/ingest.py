"""Redaction of streams: the batch plan is stateless, so it runs as it is; metrics and rates beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.resolve import OUT_SPANS
from ..plans.redaction import redact_table


def read_stream(spark: SparkSession, path: str, schema: str = "doc_id long, text string", fmt: str = "parquet", files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_trigger).load(path)


def read_folder_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """(doc_id, text) of files dropped into a folder, each a document whose id is its path; bytes that aren't UTF-8 become U+FFFD."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files_per_trigger).load(path)
    return files.select(F.col("path").alias("doc_id"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def redact_stream(docs: DataFrame, out: str, checkpoint: str, **options):
    """Redact what is there and stop; a restart goes on behind the last committed batch."""
    return redact_table(docs, **options).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def redact_batches(docs: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], **options):
    """As `redact_stream`, with a function for each batch of results and its number; a batch that is given again after a failure has the same number."""
    return redact_table(docs, **options).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def observed(results: DataFrame, name: str = "redaction") -> tuple[DataFrame, Observation]:
    """results with running counters: documents, spans, and documents to be reviewed; read from the observation after the action."""
    o = Observation(name)
    return results.observe(o, F.count("*").alias("documents_processed"), F.coalesce(F.sum("pii_count"), F.lit(0)).alias("pii_spans_total"), F.count_if("needs_review").alias("needs_review_documents")), o


def service_metrics(requests: DataFrame) -> DataFrame:
    """One row over requests (latency_ms, categories, failed): documents, errors, spans, latency sum, max and mean, spans by category."""
    done = requests.where(~F.coalesce("failed", F.lit(False)))
    counts = done.select(F.explode("categories").alias("category")).groupBy("category").agg(F.count("*").alias("n"))
    by = counts.agg(F.coalesce(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))), F.create_map().cast("map<string,bigint>")).alias("categories"))
    zero = F.lit(0.0)
    ok = ~F.coalesce("failed", F.lit(False))
    total = requests.agg(
        F.count_if(ok).alias("documents_processed"), F.count_if(~ok).alias("errors_total"), F.coalesce(F.sum(F.when(ok, F.size("categories"))), F.lit(0)).alias("pii_spans_total"),
        F.coalesce(F.sum(F.when(ok, F.col("latency_ms"))), zero).alias("latency_ms_total"), F.coalesce(F.max(F.when(ok, F.col("latency_ms"))), zero).alias("latency_ms_max"),
    )
    mean = F.when(F.col("documents_processed") > 0, F.round(F.col("latency_ms_total") / F.col("documents_processed"), 3)).otherwise(0.0)
    return total.select("*", mean.alias("latency_ms_mean")).crossJoin(F.broadcast(by))


def rate_by_window(results: DataFrame, window: str = "1 minute", late: str = "5 minutes", time_col: str = "processed_at") -> DataFrame:
    """Documents and spans by event-time window and category; rows later than `late` are left out where results are a stream."""
    spans = results.withWatermark(time_col, late).select(time_col, F.explode(F.transform(F.col("spans").cast(OUT_SPANS), lambda s: s["category"])).alias("category"))
    return spans.groupBy(F.window(time_col, window).alias("w"), "category").agg(F.count("*").alias("spans")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "category", "spans")
