"""Queries of model answers, prompts, sources and small functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import model_output as M
from ..operators import memorisation
from ..sources import converters, readers, synthetic
from . import redaction
from .registry import query, table

_D = "#"  # stands for a row's number in the answers below
#: answers in the forms that models give them, and the entities in them
ANSWERS = [
    ('{"pii": [{"category": "name", "value": "Ann#"}]}', [("name", "Ann#")]), ('```json\n[{"type": "PIICategory.EMAIL", "text": "a#@x.org"}]\n```', [("email", "a#@x.org")]),
    ('Here you are: {"entities": {"items": [{"label": "Date of Birth", "entity": "1/2/#"}]}} bye', [("date_of_birth", "1/2/#")]), ('{"data": {"data": [{"entity_type": "tfn", "detected_text": "#"}]}}', [("tfn", "#")]),
    ('{"category": "generic-id", "value": "G#"}', [("generic_id", "G#")]), ('{"name": ["A#", "B#"], "phone": "0#", "other": "x"}', [("name", "A#"), ("name", "B#"), ("phone", "0#")]),
    ('{"pii": [{"category": "planet", "value": "x"}, {"category": "name", "value": ""}, "no"]}', []), ("no answer #", []), ("{}", []), ('{"pii": [', []),
]


def _of(values: list[str]):
    k = F.col("c_custkey")
    return F.replace(F.get(F.array(*map(F.lit, values)), (k % len(values)).cast("int")), F.lit(_D), k.cast("string"))


@query("SELECT c_custkey AS k, category, replace(value, '#', c_custkey::VARCHAR) AS value FROM customer JOIN (VALUES {}) AS v(i, category, value) ON c_custkey % {} = i".format(
    ", ".join(f"({k}, '{c}', '{v}')" for k, (_, found) in enumerate(ANSWERS) for c, v in found), len(ANSWERS)
))
def model_entities(spark, sf_dir):
    answers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), _of([a for a, _ in ANSWERS]).alias("raw"))
    return M.with_entities(answers, "raw").select("k", F.inline("entities"))


_BEFORE, _AFTER = (x.replace("'", "''") for x in M.prompt("\x01")[1].split("\x01"))


@query(f"SELECT doc_id, length('{_BEFORE}' || text || '{_AFTER}')::INT AS user_chars, text AS last_block FROM documents")
def prompts(spark, sf_dir):
    p = table(spark, sf_dir, "documents").select("doc_id", M.prompt_column(F.col("text")).alias("p"))
    return p.select("doc_id", F.char_length("p.user").alias("user_chars"), M.last_block(F.col("p.user")).alias("last_block"))


@query("SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN 'd' || c_custkey WHEN 1 THEN 'i' || c_custkey END AS id FROM customer WHERE c_custkey % 4 < 3")
def result_ids(spark, sf_dir):
    k = F.col("c_custkey")
    item = F.when(k % 3 == 0, F.format_string('{"document_id": "d%d", "id": "x"}', k)).when(k % 3 == 1, F.format_string('{"document_id": "", "id": "i%d"}', k)).otherwise(F.lit("{}"))
    answer = F.when(k % 4 == 0, F.concat(F.lit("["), item, F.lit("]"))).when(k % 4 == 3, F.lit('{"results": 5}')).otherwise(F.concat(F.lit('{"results": ['), item, F.lit("]}")))
    return table(spark, sf_dir, "customer").select(k.alias("k"), F.explode(M.result_items(answer)).alias("item")).select("k", M.item_id(F.col("item")).alias("id"))


@query(r"""SELECT page_id, regexp_extract(url, '[^/]*$') AS base, lower(regexp_extract(regexp_extract(url, '[^/]*$'), '^.+(\.[^.]+)$', 1)) AS suffix FROM pages""")
def path_parts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.substring_index("url", "/", -1).alias("base"), readers.suffix(F.col("url")).alias("suffix"))


@query("""SELECT doc_id, value FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS value FROM documents) WHERE contains(value, '@') AND trim(value, ' ') <> ''""")
def token_label_values(spark, sf_dir):
    tokens = F.split("text", " ")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document"), tokens.alias("tokens")).withColumn("trailing_whitespace", F.transform("tokens", lambda t: F.lit(True)))
    marked = docs.withColumn("labels", F.transform("tokens", lambda t: F.when(F.contains(t, F.lit("@")), "B-EMAIL").otherwise("O")))
    return converters.token_labels(marked).select(F.col("document").alias("doc_id"), "value")


_VALUES = [("email", "a@b.c", True), ("email", "a@b", False), ("phone", "12-34 567", True), ("phone", "123456", False), ("generic_id", "ab1", True), ("generic_id", "abc", False), ("url", "a/b", True), ("url", "ab", False),
           ("username", "jo_12", True), ("username", "jo 12", False), ("username", "johnny", False), ("name", "", True)]


@query(f"""SELECT c_custkey AS k, category, valid FROM customer JOIN (VALUES {", ".join(f"({k}, '{c}', {str(v).lower()})" for k, (c, _, v) in enumerate(_VALUES))}) AS v(i, category, valid) ON c_custkey % {len(_VALUES)} = i""")
def label_validity(spark, sf_dir):
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k.alias("k"), *[F.get(F.array(*[F.lit(r[n]) for r in _VALUES]), (k % len(_VALUES)).cast("int")).alias(name) for n, name in ((0, "category"), (1, "value"))])
    return rows.select("k", "category", converters.valid_label(F.col("category"), F.col("value")).alias("valid"))


@query("SELECT DISTINCT doc_id::VARCHAR AS id, 'email' AS category, value FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS value FROM documents) WHERE contains(value, '@')")
def distinct_labels(spark, sf_dir):
    found = F.filter(F.split("text", " "), lambda t: F.contains(t, F.lit("@")))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", F.transform(found, lambda t: F.struct(F.lit("email").alias("category"), t.alias("value"))).alias("labels"))
    return converters.with_validity(rows).select("id", F.inline("labels")).select("id", "category", "value")


@query("""SELECT c_custkey AS k, e || ((1 * substr(e, 1, 1)::INT + 3 * substr(e, 2, 1)::INT + 7 * substr(e, 3, 1)::INT + 9 * substr(e, 4, 1)::INT + 1 * substr(e, 5, 1)::INT + 3 * substr(e, 6, 1)::INT + 7 * substr(e, 7, 1)::INT
+ 9 * substr(e, 8, 1)::INT) % 10) || '1' AS medicare, true AS ok FROM (SELECT c_custkey, lpad((c_custkey * 7919 + 20000000)::VARCHAR, 8, '0') AS e FROM customer)""")
def medicare_numbers(spark, sf_dir):
    from ..functions import checks

    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), synthetic.medicare_number(F.lpad((F.col("c_custkey") * 7919 + 20_000_000).cast("string"), 8, "0")).alias("medicare"))
    return rows.select("k", "medicare", checks.medicare(F.col("medicare")).alias("ok"))


_POLICIES = ", ".join(
    f"('{n}', '{p['description']}', '{p['username_mode']}', {p['max_text_chars']}, {p['max_batch_docs']}, {p['max_concurrency']}, {redaction.REQUIRED})" for n, p in sorted(redaction.POLICIES.items())
)


@query(f"SELECT * FROM (VALUES {_POLICIES}) AS v(name, description, username_mode, max_text_chars, max_batch_docs, max_concurrency, required_metadata)")
def policies(spark, sf_dir):
    return redaction.policy_table(spark)


_SAMPLES = "(SELECT doc_id, exp(1 + n_chars % 97 / 10.0) AS xl, exp(2 + n_chars % 89 / 10.0) AS small, exp(1.5 + n_chars % 83 / 10.0) AS lower FROM documents)"


def _samples(spark, sf_dir):
    n = F.col("n_chars")
    return table(spark, sf_dir, "documents").select("doc_id", "text", *[memorisation.perplexity(F.lit(a) + n % m / 10.0).alias(name) for name, a, m in (("xl", 1.0, 97), ("small", 2.0, 89), ("lower", 1.5, 83))])


@query(f"SELECT doc_id, round(-ln(xl), 6) AS by_likelihood, round(ln(small) / ln(xl), 6) AS by_small_model, round(ln(lower) / ln(xl), 6) AS by_lower_case FROM {_SAMPLES}")
def memorisation_metrics(spark, sf_dir):
    return memorisation.scored(_samples(spark, sf_dir)).select("doc_id", *[F.round(c, 6).alias(c) for c in ("by_likelihood", "by_small_model", "by_lower_case")])


@query()
def memorised_samples(spark, sf_dir):
    return memorisation.best(_samples(spark, sf_dir), 10, "doc_id").select("metric", "doc_id", F.round("score", 6).alias("score"))


@query()
def synthetic_corpus(spark, sf_dir):
    return synthetic.corpus(spark, 200, "mixed").unionByName(synthetic.corpus(spark, 50, "negative")).select("id", "text", "profile", F.size("labels").alias("n_labels"))
