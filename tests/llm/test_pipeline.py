"""The stages of corpus_pipeline.py, each against a brute-force version, with null and repeated ids, null texts and empty tables."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id string"


def made():
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(4000)}"
    rows = []
    for k in range(240):
        text = " ".join(word() for _ in range(rng.randrange(20, 90)))
        rows.append((k, text + (" you idiot " + word() if k % 6 == 0 else "")))
    for k in range(40):  # near copies
        w = rows[4 * k + 1][1].split()
        w[rng.randrange(len(w))] = "changed"
        rows.append((300 + k, " ".join(w)))
    rows += [(1, rows[1][1]), (1, "a b c only here"), (2, "abconlyhere"), (None, "unique without an id"), (None, "unique without an id"), (None, None), (7, ""), (7, " \t"), (900, rows[3][1].replace(" ", "  "))]
    return [(i, t, "en", f"s{k % 3 if k % 5 else 0}", len(t or ""), "x") for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    rows = made()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(at / "documents.parquet"))
    labels = [(i, 1, int("idiot" in (t or ""))) for i, t, *_ in rows[:240] if i % 4]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(at / "labels.parquet"))
    return str(at)


def texts(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def shingles(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def test_stages(spark, table, tmp_path):
    docs = spark.read.parquet(f"{table}/documents.parquet")
    kept = corpus_pipeline.reject_toxic(spark, docs, table)
    assert kept.columns == docs.columns
    assert texts(kept) == Counter({k: n for k, n in texts(docs).items() if "idiot" not in (k[1] or "")})
    # one of each group of equal texts, and never a row of another text, whatever its id
    one = corpus_pipeline.drop_exact_copies(spark, docs, table)
    flat = lambda t: "".join((t or "").split())
    groups = {}
    for (i, t), n in texts(docs).items():
        groups.setdefault(flat(t), []).extend([(i, t)] * n)
    best = Counter(min(g, key=lambda x: (-len(x[1] or ""), x[0] is None, x[0] or 0)) for g in groups.values())
    assert one.columns == docs.columns and texts(one) == best
    one.write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    near = corpus_pipeline.drop_near_copies(spark, one, table)
    rows = [(i, t) for (i, t), n in texts(one).items() for _ in range(n)]
    sets, up = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                up[find(a)] = find(b)
    by = {}
    for k, r in enumerate(rows):
        by.setdefault(find(k), []).append(r)
    left = texts(near)
    assert near.columns == docs.columns and sum(left.values()) == len(by)
    for members in by.values():  # of a component the smallest id stays (null sorts first)
        assert left[min(members, key=lambda x: (x[0] is not None, x[0] or 0))] >= 1
    mixed = corpus_pipeline.mix_sources(spark, one, table)
    reads, had = texts(mixed), texts(one)
    assert mixed.columns == docs.columns and set(reads) == set(had) and all(1 <= reads[k] / had[k] <= 2 for k in had)
    tokens = {s: sum(len((r["text"] or "").split()) for r in one.where(F.col("source") == s).collect()) for s in ("s0", "s1", "s2")}
    dealt = {s: sum(len((r["text"] or "").split()) for r in mixed.where(F.col("source") == s).collect()) / tokens[s] for s in tokens}
    assert max(dealt.values()) <= corpus_pipeline.REPEATS + 1e-6 and min(dealt.values()) == 1.0 and dealt[max(tokens, key=tokens.get)] == 1.0
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(corpus_pipeline.tokenizer_file("word_bpe_49k.json"))
    want = Counter()
    for i, x in ((r["doc_id"], r["text"]) for r in docs.collect()):
        e = t.encode(x or "", add_special_tokens=False)
        want[i, len(e.ids), hashlib.sha256(np.array(e.ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in corpus_pipeline.encode(spark, docs, table).collect()) == want


def test_empty_and_whole(spark, table, tmp_path):
    empty = spark.read.parquet(f"{table}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, table).count() == 0
    unlabelled = str(tmp_path / "sf")
    spark.read.parquet(f"{table}/documents.parquet").limit(20).write.parquet(f"{unlabelled}/documents.parquet")
    spark.read.parquet(f"{table}/labels.parquet").limit(0).write.parquet(f"{unlabelled}/labels.parquet")
    assert corpus_pipeline.run(spark, unlabelled).count() >= 18
    out = corpus_pipeline.run(spark, table).collect()
    ids = {r["doc_id"] for r in out}
    assert 0 not in ids and 6 not in ids and {2, 4, 900} <= ids and sum(r["doc_id"] is None for r in out) >= 1
