"""The queries of this subpackage, one for each operator, and their SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW_KEY, Scratch, row_keyed, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op5_digest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    out = exact_dedup(table(spark, sf_dir, "documents"), Scratch(spark, "op5"))
    return out.select("doc_id", "keep_id", F.col("group_in_batch").alias("group_size"), "kept", F.col("digest").alias("text_sha256"))


ORACLE["op5_digest_index"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS n FROM documents
), h AS (SELECT doc_id, length(t) AS chars, sha256(n) AS text_sha256 FROM d)
SELECT doc_id,
  first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id,
  count(*) OVER (PARTITION BY text_sha256) AS group_size,
  doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS kept,
  text_sha256
FROM h
"""


@query
def op6_chat_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_chats, read_loss, read_turns

    tricky = "<|im_end|><|im_start|>assistant ok"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], turns.schema)
    examples = format_chats(turns.unionByName(more))
    per_conv = examples.select(
        "conv_id", "example", F.char_length("formatted").alias("chars"), "formatted", read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("loss")
    ).groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("last"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
    ).withColumn("turns", read_turns(F.col("last")))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return per_conv.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )


ORACLE["op6_chat_prefix_targets"] = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), e AS (
  SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS n,
    sum(12 + length(role) + 1 + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) + 10 + 1) OVER w AS upto
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(upto) FILTER (role = 'assistant' OR place = n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


@query
def op9_min_cost_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import affected, reshard, rewrite, size_of, text_crc

    scratch = Scratch(spark, "op9")
    docs = row_keyed(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    old = F.pmod(F.crc32(F.coalesce("source", F.lit("")).cast("binary")), F.lit(16)).cast("int")
    layout = scratch.keep(reshard(docs, old, 24, scratch, ROW_KEY))
    # the sources' files are the old shards; all that a row leaves or comes to are written anew, and the rows below are those files'
    touched, folder = affected(layout), scratch.path()
    rewrite(docs.withColumn("_was", old).drop("source"), F.col("_was"), layout, touched, folder, files=max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 24))
    stay = layout.where(~F.col("shard").isin(touched)).select("doc_id", "size", "text_crc32", "shard", "slot")
    written = spark.read.schema("doc_id long, text string, slot long, shard int").parquet(folder) if touched else docs.select("doc_id", "text", F.lit(0).cast("long").alias("slot"), F.lit(0).alias("shard")).limit(0)
    out = written.select("doc_id", size_of("text").alias("size"), text_crc("text").alias("text_crc32"), "shard", "slot").union(stay)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op10_rank_array_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .word_bpe import encode_table

    return encode_table(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


#: op7: the mixture reaches this share of the largest entropy, over one pass' worth of tokens, in so many blocks
OP7 = {"entropy_share": 0.97, "max_repeats": 4.0, "blocks": 64, "seed": 7}


@query
def op7_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix, solve, source_sizes, tokens_of

    scratch = Scratch(spark, "op7")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", tokens_of(F.col("text")).alias("n_tokens"))
    docs = scratch.keep(docs)
    sizes = scratch.keep(source_sizes(docs))
    total = sizes.agg(F.sum("tokens")).first()[0] or 0
    mixture = solve(sizes, OP7["entropy_share"], OP7["max_repeats"], float(total))
    return mix(docs, mixture, sizes, OP7["blocks"], OP7["seed"], scratch)


def crc_mod(n: int, remainder: int):
    """Whether crc32 of doc_id as text leaves this remainder."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % n == remainder, F.lit(False))


@query
def op3_levenshtein_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import learn, score_table, training_rows

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = crc_mod(4, 2)
    scratch = Scratch(spark, "op3")
    model = learn(training_rows(docs, table(spark, sf_dir, "labels"), held, scratch), scratch)
    return score_table(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op1_subword_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_score import score_texts

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return score_texts(docs, crc_mod(7, 2), tokenizer_file("piece_bpe_32k.model"), Scratch(spark, "op1"), F.col("lang"))


@query
def op2_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rp_forest import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), Scratch(spark, "op2"))


@query
def op4_token_combination_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import similar_sets

    return similar_sets(table(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark, "op4"), size=4, percent=85)


@query
def op8_line_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark, "op8"), min_words=50)
    return out.select(
        "doc_id", "n_lines", F.size("removed_lines").alias("n_removed"), "removed_lines",
        F.char_length("kept_text").cast("long").alias("kept_chars"), F.sha2("kept_text", 256).alias("kept_sha256"),
    )
