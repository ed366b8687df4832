"""Line dedup by winnowing: fingerprints of line stretches, matched, and the stretches around them joined to whole runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, lookup
from .mixing import tokens_of


def line_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line, ord, words, hash) of the lines that hold words; ord counts those alone."""
    lines = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("line", "s"))
    full = lines.select("doc_id", "line", tokens_of(F.col("s")).alias("words"), F.xxhash64("s").alias("hash"), F.char_length("s").alias("chars")).where("words > 0")
    w = Window.partitionBy("doc_id").orderBy("line")
    return full.select("doc_id", "line", "words", F.xxhash64("hash", "chars").alias("hash"), F.row_number().over(w).alias("ord"), F.sum("words").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))


def stretches(lines: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, first, last, hash, at, print): the shortest stretches of min_words words or more, and their fingerprints.

    From each line the shortest stretch onwards, and to each line the shortest one back to
    where it begins, if it is another.  A run of min_words words or more is the
    union of those within it: a line that has min_words words from it to the run's end
    begins one, and the one back from the run's end holds all other lines.

    A stretch's fingerprint is the least of a window at its beginning: all half stretches (a line and the next ones up to half
    of min_words words) that begin within half of min_words words.  The window ends within the stretch,
    so equal stretches have equal fingerprints, and many stretches share one place of it (`at`).
    """
    half = (min_words + 1) // 2
    place = Window.partitionBy("doc_id").orderBy("_from")
    begun = lines.withColumn("_from", F.col("upto") - F.col("words"))
    near, whole = place.rangeBetween(0, half - 1), place.rangeBetween(0, min_words - 1)
    own = begun.withColumn("_hashes", F.collect_list("hash").over(near)).withColumn("_end", F.max("upto").over(near))
    own = own.withColumn("_print", F.when(F.col("_end") - F.col("_from") >= half, F.xxhash64("_hashes")))
    window = place.rangeBetween(0, min_words - half)
    own = own.withColumn("_least", F.min(F.when(F.col("_print").isNotNull(), F.struct("_print", "ord"))).over(window))
    own = own.withColumn("_onwards", F.collect_list("hash").over(whole)).withColumn("_last", F.max("ord").over(whole)).withColumn("_far", F.max("upto").over(whole))
    back = Window.partitionBy("doc_id").orderBy("upto").rangeBetween(1 - min_words, 0)
    start = F.first(F.struct("ord", "_last", "_least")).over(back)
    own = own.withColumn("_back", F.collect_list("hash").over(back)).withColumn("_start", start)
    onwards = F.when(F.col("_far") - F.col("_from") >= min_words, F.struct(F.col("ord").alias("first"), F.col("_last").alias("last"), F.xxhash64("_onwards").alias("hash"), F.col("_least").alias("p")))
    other = (F.col("upto") >= min_words) & (F.col("_start._last") != F.col("ord"))
    backwards = F.when(other, F.struct(F.col("_start.ord").alias("first"), F.col("ord").alias("last"), F.xxhash64("_back").alias("hash"), F.col("_start._least").alias("p")))
    every = own.select("doc_id", F.explode(F.array_compact(F.array(onwards, backwards))).alias("s"))
    return every.select("doc_id", "s.first", "s.last", "s.hash", F.col("s.p.ord").alias("at"), F.col("s.p._print").alias("print"))


def repeated_lines(lines: DataFrame, scratch: Scratch, min_words: int) -> DataFrame:
    """(doc_id, line) of the lines in later copies of runs of min_words words or more.

    Fingerprints that stand at one place only are settled first.  Of the stretches whose fingerprint repeats, those
    that stand at an earlier place too (by doc_id, then line), whichever, are a later copy, and their
    union is the whole runs; lines without words don't end a run.
    """
    every = scratch.keep(stretches(lines, min_words))
    places = every.groupBy("print").agg(*[f(c).alias(f"{n}_{c}") for c in ("doc_id", "at") for n, f in (("min", F.min), ("max", F.max))], F.count("*").alias("uses"))
    shared = places.where("min_doc_id < max_doc_id or min_at < max_at").select("print", "uses", F.lit(True).alias("met"))
    spread = F.struct("doc_id", "first")
    seeded = scratch.keep(lookup(every, scratch.keep(shared), "print", "uses", spread).where("met").select("doc_id", "first", "last", "hash"))
    earliest = seeded.groupBy("hash").agg(F.min(F.struct("doc_id", "first")).alias("p"), F.count("*").alias("uses")).where("uses > 1")
    earliest = scratch.keep(earliest.select("hash", F.col("p.doc_id").alias("a"), F.col("p.first").alias("b"), "uses"))
    met = lookup(seeded, earliest, "hash", "uses", spread)
    later = met.where(F.col("a").isNotNull() & ((F.col("doc_id") > F.col("a")) | (F.col("first") > F.col("b"))))
    # a line is in a stretch if one that begins at it or before it ends at it or after it
    begins = later.groupBy("doc_id", F.col("first").alias("ord")).agg(F.max("last").alias("last")).select("doc_id", "ord", F.lit(None).cast("int").alias("line"), "last")
    both = lines.select("doc_id", "ord", "line", F.lit(None).cast("int").alias("last")).union(begins)
    reach = F.max("last").over(Window.partitionBy("doc_id").orderBy("ord").rangeBetween(Window.unboundedPreceding, 0))
    return both.withColumn("reach", reach).where(F.col("line").isNotNull() & (F.col("reach") >= F.col("ord"))).select("doc_id", "line")


def dedup_lines(docs: DataFrame, scratch: Scratch, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Delete later copies of repeated runs of lines: doc_id, text, kept_text, n_lines, removed_lines (their places).

    A run is lines of min_words words or more in all that stand in the same order at an earlier place: in a document of smaller
    doc_id, or earlier in the same one.  The first copy of each line stays.
    Words are stretches between blanks; a text's lines are what stands between line ends.

    Null texts are empty; texts below min_words words stay as they are; ids are
    to be unique (rows of one id count as one document); rows of a null id stay as
    they are; an empty table gives no rows; other columns aren't read.
    DataFrame operations only.  A line that a third of all documents share is one
    row in the tables of fingerprints and of first places and reaches the documents through `lookup`.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    lines = scratch.keep(line_table(docs.where("doc_id is not null")))
    gone = repeated_lines(lines, scratch, min_words)
    gone = scratch.keep(gone.groupBy("doc_id").agg(F.sort_array(F.collect_list("line")).alias("removed_lines")))
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast("array<int>")
    both = docs.join(gone, "doc_id", "left").withColumn("removed_lines", F.coalesce("removed_lines", none))
    marks = F.map_from_entries(F.transform("removed_lines", lambda x: F.struct(x, F.lit(True))))
    left = F.array_join(F.filter(F.split(text, "\n"), lambda s, i: ~F.coalesce(marks[i], F.lit(False))), "\n")
    kept = F.when(F.size("removed_lines") > 0, left).otherwise(text)
    return both.select("doc_id", "text", kept.alias("kept_text"), F.size(F.split(text, "\n")).alias("n_lines"), "removed_lines")
