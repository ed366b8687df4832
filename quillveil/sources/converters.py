"""Public datasets as documents and expected labels: (id, text, labels), with a validity for each label."""

from __future__ import annotations

import ast
import csv
import io
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import readers

LABEL_LIST = "array<struct<category:string,value:string>>"
FIXTURE = "id string, text string, labels array<struct<category:string,value:string,valid:boolean>>"
# The datasets' labels in terms of our categories.
TOKEN_LABELS = {"NAME_STUDENT": "name", "EMAIL": "email", "PHONE_NUM": "phone", "STREET_ADDRESS": "address", "URL_PERSONAL": "url", "ID_NUM": "generic_id", "USERNAME": "username"}
PUBLIC_LABELS = {
    "EMAIL": "email", "email": "email", "EMAIL_ADDRESS": "email", "PHONE": "phone", "PHONE_NUMBER": "phone", "phone_number": "phone", "ADDRESS": "address", "STREET_ADDRESS": "address", "address": "address",
    "PERSON": "name", "PERSON_NAME": "name", "FULL_NAME": "name", "NAME": "name", "name": "name", "DATE_OF_BIRTH": "date_of_birth", "DOB": "date_of_birth", "BIRTHDATE": "date_of_birth", "URL": "url",
    "IP_ADDRESS": "ip_address", "CREDIT_CARD": "generic_id", "SSN": "generic_id", "ID": "generic_id", "ID_NUM": "generic_id", "ACCOUNT_NUMBER": "generic_id", "CITY": "address", "STREET": "address",
    "ZIPCODE": "address", "POSTCODE": "address",
}
SUPPLIED_LABELS = {
    "EMAIL": "email", "EMAIL_ADDRESS": "email", "PHONE": "phone", "PHONE_NUM": "phone", "PHONE_NUMBER": "phone", "ADDRESS": "address", "STREET_ADDRESS": "address", "CITY": "address", "STREET": "address",
    "ZIPCODE": "address", "URL": "url", "URL_PERSONAL": "url", "USERNAME": "username", "USER_NAME": "username", "ID": "generic_id", "ID_NUM": "generic_id", "SSN": "generic_id", "CREDIT_CARD": "generic_id",
    "DATE": "date", "TIME": "date",
}
CSV_COLUMNS = ["name", "email", "phone", "address", "username", "url"]


def valid_label(category: Column, value: Column) -> Column:
    """Whether a value can be what its category says: an address with a host, seven digits, an id that isn't a word, ..."""
    v = F.btrim(value)
    word = v.rlike(r"^\p{L}+$")
    user = F.char_length(v).between(5, 32) & ~v.rlike(r"(?U)[\s']") & ~word
    return (
        F.when(category == "email", F.contains(v, F.lit("@")) & F.contains(F.substring_index(v, "@", -1), F.lit("."))).when(category == "phone", F.regexp_count(v, F.lit(r"\p{Nd}")) >= 7)
        .when(category == "generic_id", (F.char_length(v) >= 3) & ~word).when(category == "url", v.rlike("[./]")).when(category == "username", user).otherwise(True)
    )


def _map(labels: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])


def with_validity(rows: DataFrame) -> DataFrame:
    """(id, text, labels): the distinct labels of each row that have a value, in order, with their validity."""
    some = F.filter("labels", lambda x: F.coalesce(x["value"] != "", F.lit(False)) & x["category"].isNotNull())
    return rows.select("id", "text", F.transform(F.array_distinct(some), lambda x: x.withField("valid", valid_label(x["category"], x["value"]))).alias("labels"))


def token_labels(records: DataFrame) -> DataFrame:
    """(document, category, value, valid) of token records: document, tokens, trailing_whitespace, labels (BIO).

    A run begins at a known label and goes on over I- labels of the same kind; unknown kinds and O end it.  Runs keep their order (`place`).
    """
    kind_of = F.when(F.contains("labels", F.lit("-")), F.expr("substring(labels, instr(labels, '-') + 1)")).otherwise(F.col("labels"))
    from pyspark.sql import Window

    rows = records.select("document", F.posexplode(F.arrays_zip("tokens", "trailing_whitespace", "labels")).alias("i", "t")).select("document", "i", "t.*")
    w = Window.partitionBy("document").orderBy("i")
    known = rows.withColumn("kind", F.when(kind_of.isin(list(TOKEN_LABELS)), kind_of))
    goes_on = F.startswith("labels", F.lit("I-")) & F.coalesce(F.lag("kind").over(w) == F.col("kind"), F.lit(False))
    runs = known.withColumn("run", F.sum(F.when(goes_on, 0).otherwise(1)).over(w)).where("kind is not null")
    piece = F.struct("i", "tokens", "trailing_whitespace")
    joined = runs.groupBy("document", "run", "kind").agg(F.array_sort(F.collect_list(piece)).alias("p"), F.min("i").alias("place"))
    last = F.size("p") - 1
    value = F.btrim(F.array_join(F.transform("p", lambda x, k: F.concat(x["tokens"], F.when(x["trailing_whitespace"] & (k < last), " ").otherwise(""))), ""))
    category = F.element_at(_map(TOKEN_LABELS), F.col("kind"))
    out = joined.select("document", "place", category.alias("category"), value.alias("value")).where("value <> ''")
    return out.select("document", "place", "category", "value", valid_label(F.col("category"), F.col("value")).alias("valid"))


def convert_tokens(records: DataFrame, prefix: str = "kaggle-", only_with_labels: bool = False) -> DataFrame:
    """Token records with full_text as a fixture; labels may repeat here."""
    found = token_labels(records).groupBy("document").agg(F.array_sort(F.collect_list(F.struct("place", "category", "value", "valid"))).alias("l"))
    rows = records.select("document", "full_text").join(found, "document", "inner" if only_with_labels else "left")
    none = F.array().cast("array<struct<category:string,value:string,valid:boolean>>")
    labels = F.coalesce(F.transform("l", lambda x: F.struct(x["category"].alias("category"), x["value"].alias("value"), x["valid"].alias("valid"))), none)
    return rows.select(F.concat(F.lit(prefix), F.col("document").cast("string")).alias("id"), F.col("full_text").alias("text"), labels.alias("labels"))


def _masked(rows: DataFrame, mask: str, table: dict[str, str], upper: bool = False) -> DataFrame:
    """Rows (id, text, mask array<struct<label,value>>) with at least one known label."""
    known = _map(table)

    def one(x: Column) -> Column:
        label = F.coalesce(F.upper(x["label"]) if upper else x["label"], F.lit(""))
        return F.struct(F.try_element_at(known, label).alias("category"), F.coalesce(x["value"], F.lit("")).alias("value"))

    listed = rows.withColumn("labels", F.filter(F.transform(F.coalesce(mask, F.array().cast("array<struct<label:string,value:string>>")), one), lambda x: x["category"].isNotNull()))
    return with_validity(listed.where(F.size("labels") > 0))


def convert_masked(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with source_text and a list privacy_mask of (label, value)."""
    rows = readers.read_jsonl(spark, path, "id string, source_text string, privacy_mask array<struct<label:string,value:string>>")
    return _masked(rows.select(F.concat(F.lit("ai4privacy-"), F.col("id")).alias("id"), F.col("source_text").alias("text"), "privacy_mask"), "privacy_mask", PUBLIC_LABELS)


def literals(rows: DataFrame, column: str, name: str = "parsed") -> DataFrame:
    """rows with a column of Python literals (or JSON) as JSON text, in Arrow batches; what can't be read is an error, as it is in the source."""
    from ..ship import ship

    ship(rows.sparkSession)
    at = rows.columns.index(column)

    def parse(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            return json.dumps(json.loads(text))
        except json.JSONDecodeError:
            return json.dumps(ast.literal_eval(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([parse(t) for t in b.column(at).to_pylist()], pa.string())], [*b.schema.names, name])

    return rows.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), f"{name} string"]))


def convert_literal_entities(rows: DataFrame) -> DataFrame:
    """Rows (uid, text, entities): entities is a literal list of {entity, types}; the first known type of each counts."""
    parsed = literals(rows.select(F.col("uid").cast("string").alias("uid"), "text", "entities"), "entities")
    entity = F.from_json("parsed", "array<struct<entity:string,types:array<string>>>")
    known = _map(PUBLIC_LABELS)

    def one(x: Column) -> Column:
        kinds = F.filter(F.transform(F.coalesce(x["types"], F.array().cast("array<string>")), lambda t: F.coalesce(F.try_element_at(known, t), F.try_element_at(known, F.upper(t)))), lambda t: t.isNotNull())
        return F.struct(F.get(kinds, F.lit(0)).alias("category"), F.coalesce(x["entity"], F.lit("")).alias("value"))

    listed = parsed.select(F.concat(F.lit("gretel-"), F.col("uid")).alias("id"), "text", F.filter(F.transform(entity, one), lambda x: x["category"].isNotNull()).alias("labels"))
    return with_validity(listed.where(F.size("labels") > 0))


def convert_csv_zip(spark: SparkSession, path: str) -> DataFrame:
    """The first CSV file in a ZIP file: a row per document, whose columns of known names are its labels."""
    from ..ship import ship

    ship(spark)
    names = ["document", "text", *CSV_COLUMNS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text in b.column(2).to_pylist():
                rows = [(k, *(r.get(n) for n in names)) for k, r in enumerate(csv.DictReader(io.StringIO(text, newline="")), 1)]
                for at in range(0, max(1, len(rows)), 10_000):
                    part = list(zip(*rows[at : at + 10_000])) or [[]] * (len(names) + 1)
                    yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int64()), *[pa.array(c, pa.string()) for c in part[1:]]], ["place", *names])

    rows = readers.read_zip(spark, path, ending=".csv").mapInArrow(run, "place long, " + ", ".join(f"{n} string" for n in names))
    labels = F.array(*[F.struct(F.lit(c).alias("category"), F.btrim(F.coalesce(F.col(c), F.lit(""))).alias("value")) for c in CSV_COLUMNS])
    number = F.when(F.coalesce("document", F.lit("")) != "", F.col("document")).otherwise(F.col("place").cast("string"))
    return with_validity(rows.select(F.concat(F.lit("usercsv-"), number).alias("id"), F.coalesce("text", F.lit("")).alias("text"), labels.alias("labels")))


def convert_masked_zip(spark: SparkSession, path: str, entry: str, languages: list[str] | None = None) -> DataFrame:
    """JSON lines in a ZIP file, of the given languages; privacy_mask is a list, or the literal of one."""
    lines = readers.read_zip(spark, path, entry).select(F.explode(F.split("text", "\r?\n")).alias("value")).where(F.trim("value") != "")
    rows = lines.select(F.from_json("value", "uid string, language string, source_text string, privacy_mask string").alias("r")).select("r.*")
    rows = rows.where(F.col("language").isin(languages)) if languages else rows
    parsed = literals(rows, "privacy_mask")
    mask = F.from_json("parsed", "array<struct<label:string,value:string>>")
    return _masked(parsed.select(F.concat(F.lit("useropenpii-"), F.col("uid")).alias("id"), F.coalesce("source_text", F.lit("")).alias("text"), mask.alias("mask")), "mask", SUPPLIED_LABELS, upper=True)


def convert(spark: SparkSession, spec: dict[str, str]) -> DataFrame:
    """One dataset by its kind: token_json, masked_jsonl, literal_parquet, csv_zip or masked_zip (with entry and languages, by commas)."""
    kind, path = spec["kind"], spec["path"]
    if kind == "token_json":
        schema = "document string, full_text string, tokens array<string>, trailing_whitespace array<boolean>, labels array<string>"
        return convert_tokens(readers.read_json_array(spark, path, schema), only_with_labels=True)
    if kind == "masked_jsonl":
        return convert_masked(spark, path)
    if kind == "literal_parquet":
        return convert_literal_entities(spark.read.parquet(path))
    if kind == "csv_zip":
        return convert_csv_zip(spark, path)
    if kind == "masked_zip":
        return convert_masked_zip(spark, path, spec["entry"], [x for x in spec.get("languages", "").split(",") if x])
    raise ValueError(f"unknown kind of dataset {kind!r}")


def convert_all(spark: SparkSession, specs: list[dict[str, str]]) -> DataFrame:
    """All datasets of a list of specs (with an id each) in one table, with the column `fixture`."""
    parts = [convert(spark, s).select(F.lit(s["id"]).alias("fixture"), "*") for s in specs]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def flat_labels(fixtures: DataFrame) -> DataFrame:
    """A row per label of a fixture table."""
    more = [c for c in ("fixture",) if c in fixtures.columns]
    return fixtures.select(*more, F.col("id").alias("document_id"), F.inline("labels"))
