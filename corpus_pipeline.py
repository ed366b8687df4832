"""A training-data pipeline over `documents`: five stages of the operators in quillveil.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of docs.  Rows are told apart by their place in the files (`row_keyed`), never by doc_id, so
ids may repeat or be null: no stage loses a row, or keeps one, because of another row's id.
Null texts count as empty; other columns are carried and not looked at; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillveil.llm.common import ROW_KEY, Scratch, row_keyed, table
from quillveil.llm.exact_dedup import exact_dedup
from quillveil.llm.jaccard_join import similar_sets
from quillveil.llm.mixing import mix, solve, source_sizes, tokens_of
from quillveil.llm.queries import tokenizer_file
from quillveil.llm.toxicity import learn, reject, training_rows
from quillveil.llm.word_bpe import encode_table

#: score from which a document is rejected
TOXIC_FROM = 0.3
#: words of a shingle, and the percentage of shingles that near copies share at least
SHINGLE, SIMILAR = 5, 80
#: readings of the most repeated source to one of the least repeated, at most
REPEATS = 1.5


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity limit, by a model of the labelled rows among them.

    The model is learned from the same rows that it then scores, as far as they are labelled; what it
    is worth on other rows is measured by query op3.  Without labels of both kinds all rows stay.
    """
    labels = table(spark, sf_dir, "labels")
    scratch = Scratch(spark, "toxic")
    return reject(docs, learn(training_rows(docs.select("doc_id", "text"), labels, F.lit(False), scratch), scratch), TOXIC_FROM)


def _ids(keyed: DataFrame) -> DataFrame:
    """(doc_id, text) with an id that no two rows share and that is ordered by doc_id first."""
    return keyed.select(F.struct("doc_id", *ROW_KEY).alias("doc_id"), "text")


def _without(keyed: DataFrame, dropped: DataFrame, columns: list[str]) -> DataFrame:
    """The rows whose key isn't among those of `dropped` (doc_id as `_ids` made it)."""
    return keyed.join(dropped.select("doc_id.*").select(*ROW_KEY), ROW_KEY, "left_anti").select(columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: that of most code points, then smallest id, then first place."""
    scratch, keyed = Scratch(spark, "exact"), row_keyed(docs)
    found = exact_dedup(_ids(keyed), scratch)
    return _without(keyed, scratch.keep(found.where("not kept").select("doc_id")), docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: that of the smallest id, then first place."""
    scratch, keyed = Scratch(spark, "near"), row_keyed(docs)
    found = similar_sets(_ids(keyed), scratch, SHINGLE, SIMILAR)
    return _without(keyed, scratch.keep(found.where("doc_id <> component_id").select("doc_id")), docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture reads it, once at least."""
    scratch, keyed = Scratch(spark, "mix"), row_keyed(docs)
    counted = scratch.keep(keyed.select("doc_id", "source", tokens_of(F.col("text")).alias("n_tokens"), *ROW_KEY))
    sizes = scratch.keep(source_sizes(counted))
    dealt = mix(counted, solve(sizes, max_repeats=REPEATS), sizes, blocks=64, seed=7, scratch=scratch)
    # rows read once, which are most, need no lookup
    often = scratch.keep(dealt.groupBy(*ROW_KEY).agg(F.max("epoch").alias("_more")).where("_more > 0"))
    reads = F.explode(F.sequence(F.lit(0), F.coalesce("_more", F.lit(0))))
    return keyed.join(often, ROW_KEY, "left").select(*docs.columns, reads.alias("_read")).drop("_read")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids' and decoded texts' digests of every document."""
    return encode_table(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: SQL can't express the learned model, the shingle join and the encoder
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each from what the one before has written."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        done = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return done
        before, docs = docs, scratch.keep(done)
        scratch.drop(before)
    return docs
