"""Audit rows: encrypted values and offsets, append, purge and re-identification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def audit_rows(results: DataFrame, run_id: str, key: str | None, model: str = "regex", enabled: bool = True) -> DataFrame:
    """A row per span of results that keep their values; offsets are -1 in clear text.

    key: 16, 24 or 32 characters; without one the encrypted column is empty.  Not enabled: no rows (audit ids
    are those of `audit_ids` all the same).
    """
    s = results.select("document_id", F.explode("spans").alias("s")).where(F.lit(enabled))
    payload = F.to_json(F.struct(F.col("s.value").alias("value"), F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end")))
    sealed = F.base64(F.aes_encrypt(payload, F.lit(key))) if key else F.lit("")
    return s.select(
        _id(run_id).alias("audit_id"), F.col("document_id").cast("string").alias("document_id"),
        F.current_timestamp().alias("timestamp"), F.col("s.category").alias("category"), F.lit(-1).alias("span_start"), F.lit(-1).alias("span_end"),
        sealed.alias("value_encrypted"), F.coalesce("s.placeholder", F.lit("")).alias("placeholder"), F.col("s.confidence").alias("confidence"),
        F.col("s.validator_passed").alias("validator_passed"), F.lit(model).alias("model_used"),
    )


def _id(run_id: str):
    return F.sha2(F.concat_ws("|", F.lit(run_id), F.col("document_id").cast("string")), 256)


def audit_ids(results: DataFrame, run_id: str) -> DataFrame:
    """(document_id, audit_id) of every document, with spans or without."""
    return results.select("document_id", _id(run_id).alias("audit_id"))


def append(rows: DataFrame, path: str) -> None:
    """Add audit rows to a log of JSON lines; ciphertexts are made anew on each reading of `rows`, so they are written from one."""
    rows.write.mode("append").option("ignoreNullFields", "false").json(path)


def purge(log: DataFrame, ids: DataFrame) -> DataFrame:
    """Audit rows without those of the given audit_ids."""
    return log.join(ids.select("audit_id").distinct(), "audit_id", "left_anti")


def purge_lines(lines: DataFrame, ids: DataFrame) -> DataFrame:
    """Lines (value) of a JSON log without those of the ids; broken lines that hold an id go too.

    Ids are stretches of letters, digits, _ and -; a broken line is cut into such stretches (and, since an id may be glued to others of these
    characters, into all windows of the ids' lengths), which meet the ids on equality.
    """
    wanted = ids.select(F.col("audit_id").cast("string").alias("_x")).distinct()
    numbered = lines.select("value", F.get_json_object("value", "$.audit_id").alias("_id"), F.monotonically_increasing_id().alias("_line"))
    left = numbered.join(wanted, F.col("_id") == F.col("_x"), "left_anti")
    lengths = wanted.agg(F.collect_set(F.char_length("_x")).alias("_ns"))
    broken = left.where("_id is null").crossJoin(F.broadcast(lengths)).select("_line", "value", F.explode("_ns").alias("_n")).where((F.col("_n") > 0) & (F.char_length("value") >= F.col("_n")))
    windows = broken.select("_line", F.explode(F.transform(F.sequence(F.lit(1), F.char_length("value") - F.col("_n") + 1), lambda i: F.substring(F.col("value"), i, F.col("_n")))).alias("_x"))
    hit = windows.join(wanted, "_x", "left_semi").select("_line").distinct()
    return left.join(hit, "_line", "left_anti").select("value")


def reidentify(log: DataFrame, audit_id: str, key: str | None) -> DataFrame:
    """Values and offsets of one audit id; older rows hold the bare value.  Without a key there is no way to them, and that is an error."""
    if not key:
        raise RuntimeError("re-identification needs the key that the log was written with")
    plain = F.aes_decrypt(F.unbase64("value_encrypted"), F.lit(key)).cast("string")
    parsed = F.from_json("plain", "value string, span_start int, span_end int")
    rows = log.where((F.col("audit_id") == audit_id) & (F.col("value_encrypted") != "")).withColumn("plain", plain)
    return rows.select("category", "placeholder", F.coalesce(parsed["value"], F.when(~F.col("plain").startswith("{"), F.col("plain"))).alias("value"), parsed["span_start"].alias("span_start"), parsed["span_end"].alias("span_end"))


def reidentify_lines(lines: DataFrame, audit_id: str, key: str | None) -> DataFrame:
    """`reidentify` over the lines (value) of a JSON log; a line that can't be read is an error, unlike in a purge."""
    schema = "audit_id string, category string, placeholder string, value_encrypted string, _broken string"
    parsed = lines.where(F.trim("value") != "").select(F.from_json("value", schema, {"columnNameOfCorruptRecord": "_broken"}).alias("r"))
    checked = F.when(F.col("r._broken").isNotNull(), F.raise_error(F.lit("a line of the audit log can't be read"))).otherwise(F.col("r.audit_id"))
    return reidentify(parsed.select(checked.cast("string").alias("audit_id"), "r.category", "r.placeholder", "r.value_encrypted"), audit_id, key)
