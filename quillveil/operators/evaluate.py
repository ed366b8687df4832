"""Leak counts, coverage, latency and run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



# Categories that patterns alone can't be held to, and what of an audit row is no text to search.
MODEL_ONLY = ["name", "address", "date_of_birth"]
AUDIT_HIDDEN = ["audit_id", "timestamp", "value_encrypted"]


def in_scope(labels: DataFrame, patterns_only: bool = False) -> DataFrame:
    """Labels that a leak check looks at: valid (null: valid), with a value, and of a category that the run can be held to."""
    known = labels.where(F.coalesce("valid", F.lit(True)) & (F.col("value") != ""))
    return known.where(~F.col("category").isin(MODEL_ONLY)) if patterns_only else known


def leaks(results: DataFrame, labels: DataFrame, patterns_only: bool = False) -> DataFrame:
    """Labels in scope with whether their value still stands in what is given out of their document.

    results: document_id and redacted_text, or `payload` (the whole result as text) where there is such a column; labels: document_id, category, value,
    valid.  A label without a result is checked against nothing: it counts, and can't leak (`found` false).
    """
    text = F.col("payload" if "payload" in results.columns else "redacted_text")
    own = results.select("document_id", text.alias("_text"), F.lit(True).alias("found"))
    joined = in_scope(labels, patterns_only).join(own, "document_id", "left")
    return joined.select("document_id", "category", "value", F.coalesce("found", F.lit(False)).alias("found"), F.coalesce(F.contains("_text", "value"), F.lit(False)).alias("leaked"))


def leaks_by_document(documents: DataFrame, results: DataFrame, labels: DataFrame, patterns_only: bool = False) -> DataFrame:
    """A row for each document, labelled or not: labels checked, and those that leaked."""
    checked = leaks(results, labels, patterns_only).groupBy("document_id").agg(F.count("*").alias("checked"), F.count_if("leaked").alias("leaks"))
    zero = F.lit(0).cast("long")
    return documents.select("document_id").join(checked, "document_id", "left").select("document_id", F.coalesce("checked", zero).alias("checked"), F.coalesce("leaks", zero).alias("leaks"))


def leak_rollup(checked: DataFrame) -> DataFrame:
    """Leaks and checked labels by category, and in all (category null)."""
    return checked.rollup("category").agg(F.count_if("leaked").alias("leaks"), F.count("*").alias("checked")).withColumn(
        "sensitivity", F.when(F.col("checked") > 0, (F.col("checked") - F.col("leaks")) / F.col("checked"))
    )


def payload(results: DataFrame) -> DataFrame:
    """(document_id, payload): a result as sorted JSON without its time, as leak checks read it."""
    cols = sorted(c for c in results.columns if c != "processed_at")
    return results.select("document_id", F.to_json(F.struct(*cols)).alias("payload"))


def label_counts(labels: DataFrame, valid_only: bool = True) -> DataFrame:
    """Labels by category."""
    return (labels.where(F.coalesce("valid", F.lit(True))) if valid_only else labels).groupBy("category").agg(F.count("*").alias("n"))


def detected_counts(results: DataFrame) -> DataFrame:
    """Spans by category."""
    return results.select(F.explode(F.transform("spans", lambda s: s["category"])).alias("category")).groupBy("category").agg(F.count("*").alias("n"))


def nearest_rank(values: DataFrame, column: str, percents: list[float], groups: list[str] | None = None) -> DataFrame:
    """Percentiles at place round(p / 100 * (n - 1)), halves to even, of the sorted values, nulls left out.

    Equal values are counted first; places come from range-dealt stretches, so neither the values nor the distinct ones meet in a task.
    """
    groups = groups or []
    counts = values.where(F.col(column).isNotNull()).groupBy(*groups, column).agg(F.count("*").alias("_c"))
    part = _running(counts, column, groups)
    total = values.where(F.col(column).isNotNull()).groupBy(*groups).agg(F.count("*").alias("_total"))
    wanted = total.select(*groups, "_total", F.explode(F.array(*[F.lit(float(p)) for p in percents])).alias("p"))
    at = wanted.select(*[F.col(g).alias(f"_h_{g}") for g in groups], "p", F.bround(F.col("p") / 100 * (F.col("_total") - 1)).alias("_at"))
    on = F.col("_last") >= F.col("_at")
    for g in groups:
        on = on & F.col(g).eqNullSafe(F.col(f"_h_{g}"))
    return part.join(F.broadcast(at), on).groupBy(*groups, "p").agg(F.min(column).alias("value"))


def _running(counts: DataFrame, column: str, groups: list[str]) -> DataFrame:
    """counts with `_last`, the place of the last row of each value in its group."""
    from pyspark.sql import Window

    from .ranks import dealt

    rows = dealt(counts, [column], groups)
    inside = Window.partitionBy("_part", *groups).orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("_part", *groups).agg(F.sum("_c").alias("_n"))
    starts = sizes.select(F.col("_part").alias("_p"), *[F.col(g).alias(f"_g_{g}") for g in groups], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    on = F.col("_part") == F.col("_p")
    for g in groups:
        on = on & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    summed = rows.withColumn("_upto", F.sum("_c").over(inside)).join(starts, on)
    return summed.select(*groups, column, (F.col("_upto") + F.col("_before") - 1).alias("_last"))


def latencies(values: DataFrame, column: str, percents: list[float] = (95,)) -> DataFrame:
    """One row: min, mean, median, max and p<percent> of a column; zeros without values."""
    ps = nearest_rank(values, column, list(percents)).groupBy().pivot("p", [float(p) for p in percents]).agg(F.first("value"))
    ps = ps.select(*[F.coalesce(F.col(f"`{float(p)}`").cast("double"), F.lit(0.0)).alias(f"p{p:g}") for p in percents])
    zero = F.lit(0.0)
    own = values.agg(*[F.coalesce(f(column).cast("double"), zero).alias(n) for n, f in (("min", F.min), ("mean", F.avg), ("median", F.median), ("max", F.max))])
    return own.crossJoin(F.broadcast(ps)) if not ps.isEmpty() else own.select("*", *[zero.alias(f"p{p:g}") for p in percents])


def rates(documents: Column, seconds: Column) -> list[Column]:
    """Documents a second and a day; 0 where no time has passed."""
    per_second = F.when(seconds > 0, documents / seconds).otherwise(0.0)
    return [per_second.alias("docs_per_second"), (per_second * 86_400).alias("docs_per_day")]


def metrics(results: DataFrame, seconds: Column) -> DataFrame:
    """Documents, detections, and documents a second and a day."""
    total = results.agg(F.count("*").alias("documents"), F.sum("pii_count").alias("detections"))
    return total.select("*", *rates(F.col("documents"), seconds))


def batch_summary(batches: DataFrame, requested: int, seconds: float, errors: int = 0) -> DataFrame:
    """One row for a run in batches (batch, latency_ms, documents): counts, rates, latencies with p90, p95 and p99, status and whether it is partial."""
    n = F.coalesce(F.sum("documents"), F.lit(0)).cast("long")
    status = F.when((F.col("documents_done") == requested) & (F.lit(errors) == 0), "OK").otherwise("PARTIAL")
    total = batches.agg(F.count("*").alias("batches_completed"), n.alias("documents_done"))
    return total.select(
        status.alias("status"), F.col("documents_done").alias("documents"), F.lit(requested).cast("long").alias("documents_requested"), "batches_completed", *rates(F.col("documents_done"), F.lit(float(seconds))),
        F.lit(errors).cast("long").alias("error_count"), (status != "OK").alias("partial"),
    ).crossJoin(F.broadcast(latencies(batches, "latency_ms", [90, 95, 99])))


def audit_text(log: DataFrame) -> DataFrame:
    """Audit rows as the text that is searched for values: sorted JSON without ids, times and ciphertext."""
    cols = sorted(c for c in log.columns if c not in AUDIT_HIDDEN)
    return log.select(F.to_json(F.struct(*cols)).alias("line"))


def audit_leaks(log: DataFrame, labels: DataFrame, patterns_only: bool = False) -> DataFrame:
    """(category, value, labels): values in scope that stand anywhere in the audit rows' plain text, with how many labels have them.

    What can stand there is a small set of texts (ids, categories, placeholders, models), so the distinct lines of the log are
    split into pieces at every place where a value could begin, and pieces meet values on their first characters; values shorter than
    that are compared with the distinct lines of the log, which a size check bounds.
    """
    values = in_scope(labels, patterns_only).groupBy("category", "value").agg(F.count("*").alias("labels")).withColumn("_n", F.char_length("value"))
    lines = audit_text(log).distinct()
    width = 4
    pieces = lines.select("line", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length("line") - width + 1))).alias("_at")).select(
        "line", "_at", F.substring("line", F.col("_at"), F.lit(width)).alias("_key")
    )
    long = values.where(F.col("_n") >= width).withColumn("_key", F.left("value", F.lit(width)))
    met = long.join(pieces, "_key").where(F.substring("line", F.col("_at"), F.col("_n")) == F.col("value")).select("category", "value", "labels").distinct()
    short = values.where(F.col("_n") < width).withColumn("_key", F.col("value"))
    grams = lines.select("line", F.explode(F.array(*[F.lit(k) for k in range(1, width)])).alias("_k")).select(
        F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length("line") - F.col("_k") + 1)), lambda i: F.substring(F.col("line"), i, F.col("_k")))).alias("_key")
    ).distinct()
    return met.union(short.join(grams, "_key", "left_semi").select("category", "value", "labels"))


def audit_summary(log: DataFrame, labels: DataFrame, detected: Column | None = None, patterns_only: bool = False) -> DataFrame:
    """One row: audit lines, those with ciphertext, and labels whose value stands in plain text."""
    own = log.agg(F.count("*").alias("line_count"), F.count_if(F.coalesce(F.col("value_encrypted") != "", F.lit(False))).alias("encrypted_value_count"))
    found = audit_leaks(log, labels, patterns_only).agg(F.coalesce(F.sum("labels"), F.lit(0)).alias("plaintext_leak_count"))
    return own.crossJoin(F.broadcast(found))


def audit_verdict(output_leaks: Column, plaintext_leaks: Column, encrypted: Column, detected: Column) -> Column:
    """PASS without leaks of either kind, and with ciphertext wherever something was detected."""
    return F.when((output_leaks == 0) & (plaintext_leaks == 0) & ((encrypted > 0) | (detected == 0)), "PASS").otherwise("FAIL")


def run_rollup(results: DataFrame) -> DataFrame:
    """One row over runs (fixture, documents, leaks): how many passed and failed; a run passes without leaks."""
    ok = F.coalesce(F.col("leaks") == 0, F.lit(False)) & (F.coalesce("exit_code", F.lit(0)) == 0 if "exit_code" in results.columns else F.lit(True))
    total = results.withColumn("_ok", ok).agg(F.count("*").alias("runs"), F.count_if("_ok").alias("passed"), F.count_if(~F.col("_ok")).alias("failed"), F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"))
    return total.select(F.when(F.col("failed") == 0, "PASS").otherwise("FAIL").alias("status"), "*")


def registry(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each fixture: documents, and valid labels by category as a map of sorted keys.

    documents: fixture, document_id; labels: fixture, category, valid.
    """
    counts = labels.where(F.coalesce("valid", F.lit(True))).groupBy("fixture", "category").agg(F.count("*").alias("n"))
    maps = counts.groupBy("fixture").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("category_counts"))
    tier = F.when(F.startswith("fixture", F.lit("pii-")), "proof").when(F.col("fixture").rlike("kaggle|ai4privacy|gretel|user"), "external").otherwise("scale")
    return documents.groupBy("fixture").agg(F.count("*").alias("document_count")).join(maps, "fixture", "left").select(
        "fixture", tier.alias("tier"), "document_count", F.coalesce("category_counts", F.create_map().cast("map<string,bigint>")).alias("category_counts"), F.lit(True).alias("required")
    )


def select_fixtures(fixtures: DataFrame, profile: str, quick: list[str] | None = None) -> DataFrame:
    """quick: the named ones; proper: the required ones (null: required); anything else: all."""
    if profile == "quick":
        return fixtures.where(F.col("fixture").isin(quick or []))
    return fixtures.where(F.coalesce("required", F.lit(True))) if profile == "proper" else fixtures


def labels_by_document(nested: DataFrame, flat: DataFrame) -> DataFrame:
    """(document_id, labels) of two label schemas together: rows with a list `labels` under `id`, and rows of one label each under document_id."""
    kind = "category", "value", "valid"
    one = nested.select(F.col("id").alias("document_id"), F.explode("labels").alias("l")).select("document_id", *[F.col(f"l.{k}").alias(k) for k in kind])
    both = one.unionByName(flat.select("document_id", *[c for c in kind if c in flat.columns]), allowMissingColumns=True)
    return both.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct(*kind))).alias("labels"))
