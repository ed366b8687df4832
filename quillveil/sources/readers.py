"""Document sources: JSON lines, folders of text files, labels, archives and crawls; and the sinks of texts and JSON lines."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranks import ranked

# Endings of the files a folder scan takes.
TEXT_FILES = [".txt", ".md", ".json", ".jsonl", ".csv", ".yaml", ".yml"]
LABELS = "id string, labels array<struct<category:string,value:string,valid:boolean>>"


def read_jsonl(spark: SparkSession, path: str, schema: str = "id string, text string, profile string") -> DataFrame:
    """JSON lines; blank lines give no row."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The objects of files that are each one JSON array."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(document_id, category, value, valid), a row per label."""
    return read_jsonl(spark, path, LABELS).select(F.col("id").alias("document_id"), F.inline("labels"))


def suffix(path: Column) -> Column:
    """A file name's ending, lower-case with its full stop, or an empty text."""
    name = F.substring_index(path, "/", -1)
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))


def relative(path: Column, root: str) -> Column:
    """A path below a root; the file's name alone where the root is the file itself."""
    plain = F.regexp_replace(path, r"^[A-Za-z]+:(?://[^/]*)?/+", "/")
    top = "/" + root.split("://")[-1].split(":", 1)[-1].strip("/")
    return F.when(F.startswith(plain, F.lit(top + "/")), F.substring(plain, F.lit(len(top) + 2), F.char_length(plain))).otherwise(F.substring_index(plain, "/", -1))


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """(path, relative_path, text) of the text files under a folder, or of one file whatever its ending; bytes that aren't UTF-8 become U+FFFD."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    below = relative(F.col("path"), path)
    alone = ~F.contains(F.regexp_replace("path", "^[A-Za-z]+:/+", "/"), F.lit(path.split("://")[-1].split(":", 1)[-1].rstrip("/") + "/"))
    wanted = suffix(F.col("path")).isin(TEXT_FILES) | alone
    return files.where(wanted).select("path", below.alias("relative_path"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def with_source_ids(files: DataFrame, prefix: str) -> DataFrame:
    """PREFIX-000001, ... in the order of paths."""
    return ranked(files, ["path"], "_place").select(*files.columns, F.concat(F.lit(prefix), F.format_string("-%06d", F.col("_place") + 1)).alias("source_id"))


def unzipped(files: DataFrame, entry: str | None = None, ending: str = "") -> DataFrame:
    """(path, entry, text) of one entry of each ZIP file (binaryFile rows): the one named, or the first of an ending."""
    from ..ship import ship

    ship(files.sparkSession)
    name = entry.replace("\\", "/") if entry else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    found = name if name is not None else next((n for n in z.namelist() if n.endswith(ending)), None)
                    if found is not None:
                        rows.append((path, found, z.read(found).decode("utf-8")))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows) if rows else [[]] * 3)], ["path", "entry", "text"])

    return files.select("path", "content").mapInArrow(run, "path string, entry string, text string")


def read_zip(spark: SparkSession, path: str, entry: str | None = None, ending: str = "") -> DataFrame:
    return unzipped(spark.read.format("binaryFile").load(path), entry, ending)


def read_wet(spark: SparkSession, path: str) -> DataFrame:
    """(path, position, text) of the English records of WET files: the record's lines from the tenth on, the last record of a file left out.

    Files are cut at lines with WARC/1.0; a record's language is its eighth line.
    """
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.split("value", "\n").alias("lines"))
    starts = F.filter(F.transform("lines", lambda line, i: F.when(F.contains(line, F.lit("WARC/1.0")), i)), lambda i: i.isNotNull())
    pairs = whole.withColumn("_s", starts).select("path", "lines", F.posexplode(F.transform(F.slice("_s", 1, F.greatest(F.size("_s") - 1, F.lit(0))), lambda a, k: F.struct(a.alias("a"), F.get(F.col("_s"), k + 1).alias("b")))).alias("position", "r"))
    english = pairs.where(F.contains(F.get("lines", F.col("r.a") + 7), F.lit("WARC-Identified-Content-Language: eng")))
    body = F.slice("lines", F.col("r.a") + 11, F.greatest(F.col("r.b") - F.col("r.a") - 10, F.lit(0)))
    return english.select("path", "position", F.concat(F.array_join(body, "\n"), F.lit("\n")).alias("text"))


def write_texts(results: DataFrame, root: str) -> DataFrame:
    """Write each redacted text to root/relative_path, and return (document_id, output_path, error).

    Texts are UTF-8 and go through Hadoop's file systems, from the task that holds them; a text that can't be written
    has its error and no path.  Where documents have no relative_path the table is written as parquet instead.
    """
    if "relative_path" not in results.columns:
        results.select("document_id", "redacted_text").write.mode("overwrite").parquet(root)
        return results.select("document_id", F.lit(root).alias("output_path"), F.lit(None).cast("string").alias("error"))
    from pyarrow import fs

    filesystem, base = fs.FileSystem.from_uri(root if "://" in root else "file://" + posixpath.abspath(root.removeprefix("file:")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths, errors = [], []
            for below, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                at = posixpath.join(base, below)
                try:
                    filesystem.create_dir(posixpath.dirname(at), recursive=True)
                    with filesystem.open_output_stream(at) as out:
                        out.write((text or "").encode("utf-8"))
                    paths.append(at)
                    errors.append(None)
                except OSError as e:
                    paths.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(paths, pa.string()), pa.array(errors, pa.string())], ["document_id", "output_path", "error"])

    kind = results.schema["document_id"].dataType.simpleString()
    return results.select("document_id", "relative_path", "redacted_text").mapInArrow(run, f"document_id {kind}, output_path string, error string")


def write_jsonl(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines with sorted keys, nulls written."""
    rows.select(*sorted(rows.columns)).write.mode(mode).option("ignoreNullFields", "false").json(path)
