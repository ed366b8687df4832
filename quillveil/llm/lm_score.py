"""LM scoring by a subword lattice, with word arcs and a mixture over classes of text."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, heaviest, small_batches
from .lattice import Pieces, expected_counts, load_pieces, log_likelihood

#: words that go to the workers as a table: the most frequent ones of up to HOT_BYTES bytes, and longer ones that have more than 1 / HOT_WORDS of all
#: uses; since each use holds the word, all of these together have no more than HOT_WORDS times the mean word's bytes
HOT_WORDS = 200_000
HOT_BYTES = 48
#: classes that get word counts of their own: the most frequent ones in training; all others are one more class
MAX_CLASSES = 6
#: rounds of expectation maximisation for the pieces
ROUNDS = 1
#: words that the lattice is worked over at once, so that blocks of equal length are long
WORDS_AT_ONCE = 60_000
#: count that every piece has before any word is seen
PIECE_PRIOR = 0.01


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) stretches without blanks [\\x20\\x09-\\x0D], in UTF-8."""
    return (text or "").encode().lower().split()


@dataclass(frozen=True)
class Model:
    """Totals of the training rows; per class k: documents, tokens and distinct words (ends included), and its discount.

    novel: of the words that are new to a class, the share that is new to all text.
    """

    tokens: int
    distinct: int
    docs: int
    class_docs: tuple[int, ...]
    class_tokens: tuple[int, ...]
    class_distinct: tuple[int, ...]
    discounts: tuple[float, ...]
    novel: float

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 1) / (self.tokens + 1.0 * (self.distinct + 1)))

    def word_log_p(self, counts: np.ndarray, log_z: np.ndarray) -> np.ndarray:
        """Natural log probability of words, a column for each class.

        counts: training counts by class.  A word's lattice has an arc for the
        whole word, where training has seen it, beside those of its pieces: the class' discounted count, and with the
        discounted mass the count in all text or, by the share of novel words, log_z, which the
        forward recursion gives for all segmentations into pieces.
        """
        below = np.exp(np.maximum(log_z, -700.0))
        back = (1 - self.novel) * counts.sum(axis=1) / self.tokens + self.novel * below
        out = np.empty(counts.shape)
        for k in range(counts.shape[1]):
            n, mass = self.class_tokens[k], self.discounts[k] * self.class_distinct[k] / self.class_tokens[k]
            p = np.maximum(counts[:, k] - self.discounts[k], 0) / n + mass * back
            # of long words all of this can underflow; in log space it can't
            out[:, k] = np.where(p > 1e-290, np.log(np.maximum(p, 1e-300)), np.log(mass) + np.log(self.novel) + log_z)
        return out

    def end_log_p(self) -> np.ndarray:
        return np.array([math.log(d / n) for d, n in zip(self.class_docs, self.class_tokens)])

    def prior(self) -> np.ndarray:
        return np.log(np.array(self.class_docs) / sum(self.class_docs))


def discount(once: int, twice: int) -> float:
    """What is taken from each count, by how many words are seen once and twice; never nothing, as new words need some."""
    return min(0.95, max(0.1, (once + 1) / (once + 2 * twice + 2)))


def _class_column(klass: Column, classes: list) -> Column:
    """Number of a training row's class; those that have no number of their own share the next one."""
    out = F.lit(len(classes))
    for k, c in enumerate(classes):
        out = F.when(klass.eqNullSafe(F.lit(c)), F.lit(k)).otherwise(out)
    return out.cast("int")


def count_words(docs: DataFrame, classes: int) -> DataFrame:
    """(word, c0, c1, ...): training counts by class of every word, 0 for words of held-out texts alone.

    docs: text, klass (null: held out).  Counts are added up within a task first,
    up to a bounded number of words at a time.
    """
    names = [f"c{k}" for k in range(classes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [Counter() for _ in range(classes)]
        other: set[bytes] = set()

        def out() -> pa.RecordBatch:
            keys = list(set().union(other, *held))
            cols = [pa.array(keys, pa.binary()), *[pa.array([h[w] for w in keys], pa.int64()) for h in held]]
            for h in held:
                h.clear()
            other.clear()
            return pa.RecordBatch.from_arrays(cols, ["word", *names])

        for batch in batches:
            for text, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                if k is None:
                    other.update(words)
                else:
                    held[k].update(words)
            if sum(map(len, held)) + len(other) > 600_000:
                yield out()
        yield out()

    rows = docs.mapInArrow(run, "word binary, " + ", ".join(f"{n} long" for n in names))
    return rows.groupBy("word").agg(*[F.sum(n).alias(n) for n in names])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together up to WORDS_AT_ONCE rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= WORDS_AT_ONCE:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def fit_pieces(words: DataFrame, pieces: Pieces, log_p: np.ndarray) -> np.ndarray:
    """One round of expectation maximisation over every distinct training word.

    Each word counts once: the pieces are there for words that training has not
    seen, and those are like rare ones.  What comes to the driver is a number for each piece.
    """
    sc = words.sparkSession.sparkContext
    shared = sc.broadcast((pieces, log_p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, lp = shared.value
        total = np.zeros(p.size)
        for batch in _joined(batches):
            w = batch.column(0).to_pylist()
            total += expected_counts(w, np.ones(len(w)), p, lp)[0]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["piece", "n"])

    total = np.full(pieces.size, PIECE_PRIOR)
    for r in words.mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n")).collect():
        total[r[0]] += r[1]
    return np.log(total / total.sum())


def score_texts(docs: DataFrame, held_out: Column, model_file: str, scratch: Scratch, klass: Column | None = None) -> DataFrame:
    """Score every whole text, learning from the rows that aren't held out.

    docs: doc_id, text, and what `held_out` and `klass` need.  klass: a class of
    the training rows (their language, say); texts are scored without it, as the mixture over
    classes.  Words are stretches without blanks after lower-casing A-Z, and an end
    token closes each text.

    Returns doc_id, held_out, n_tokens (words and the end), n_known (those seen in
    training), train_tokens, base_score (add-one unigram), score: log10 of the
    probability that the model gives to the text, which is the product over words of the
    sums over all segmentations, and of the end, summed over classes (scores of
    all texts of all lengths add up to 1 at most); and lattice_score: log10 of the words' probabilities by the pieces alone.

    Null and empty texts have one token, the end; a null doc_id is scored like
    any other; rows that repeat an id are scored each (told apart by a row
    number); with no training row at all the counts are 0 and only pieces and
    an end at even odds remain; an empty table gives no rows; other columns aren't read.

    Frequent words are looked up in a broadcast table of at most HOT_WORDS words of
    HOT_BYTES bytes; the rest meets the words' table by an exchange on the word, where
    no word has more than 1 / HOT_WORDS of all tokens, one row for each text and word.
    """
    spark = scratch.spark
    small_batches(spark, 500)
    pieces = load_pieces(model_file)
    docs = docs.select("doc_id", "text", held_out.alias("held_out"), (klass if klass is not None else F.lit(None).cast("string")).alias("klass"))
    train = docs.where(~F.col("held_out"))
    by_class = [(r[0], r[1]) for r in train.groupBy("klass").count().orderBy(F.desc("count"), "klass").limit(MAX_CLASSES).collect()]
    n_train = train.count() if len(by_class) == MAX_CLASSES else sum(n for _, n in by_class)
    class_docs = [n for _, n in by_class]
    if n_train > sum(class_docs):
        class_docs.append(n_train - sum(class_docs))
    class_docs = class_docs or [1]
    n_classes = len(class_docs)
    names = [f"c{k}" for k in range(n_classes)]
    number = F.when(~F.col("held_out"), _class_column(F.col("klass"), [c for c, _ in by_class]))
    counts = scratch.keep(count_words(docs.select("text", number.alias("k")), n_classes))
    every = sum((F.col(n) for n in names), F.lit(0))
    totals = counts.agg(
        F.sum(every).alias("t"), F.count_if(every > 0).alias("v"), F.count_if(every == 1).alias("once"), *[F.sum(n).alias(f"t{n}") for n in names],
        *[F.count_if(F.col(n) > 0).alias(f"v{n}") for n in names], *[F.count_if(F.col(n) == 1).alias(f"o{n}") for n in names], *[F.count_if(F.col(n) == 2).alias(f"w{n}") for n in names],
    ).first()
    model = Model(
        (totals["t"] or 0) + n_train, totals["v"] + (n_train > 0), n_train, tuple(class_docs),
        tuple((totals[f"t{n}"] or 0) + d for n, d in zip(names, class_docs)), tuple(totals[f"v{n}"] + 1 for n in names),
        # a word that its class has seen once would be new without that use; it would be new to all text if no other class has it
        tuple(discount(totals[f"o{n}"], totals[f"w{n}"]) for n in names), (totals["once"] + 1) / (sum(totals[f"o{n}"] for n in names) + 2),
    )
    if not n_train:
        model = Model(0, 0, 0, (1,), (2,), (1,), (0.5,), 0.5)
    log_p = pieces.prior
    for _ in range(ROUNDS if n_train else 0):
        log_p = fit_pieces(counts.where(every > 0).select("word"), pieces, log_p)
    return _score(docs, counts, names, model, pieces, log_p, scratch)


def _score(docs: DataFrame, counts: DataFrame, names: list[str], model: Model, pieces: Pieces, log_p: np.ndarray, scratch: Scratch) -> DataFrame:
    spark = scratch.spark
    n_classes = len(names)
    shared = spark.sparkContext.broadcast((pieces, log_p, model))
    sums = [f"s{k}" for k in range(n_classes)]

    def lattices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, lp, m = shared.value
        for batch in _joined(batches):
            words = batch.column(0).to_pylist()
            got = np.stack([batch.column(k + 1).to_numpy() for k in range(n_classes)], axis=1).astype(float)
            z = log_likelihood(words, p, lp)
            logs = _word_scores(m, got, z)
            total = got.sum(axis=1)
            yield from pa.table(
                [batch.column(0), pa.array((total > 0).astype(np.int64)), pa.array(_base(m, total)), pa.array(z), *[pa.array(logs[:, k]) for k in range(n_classes)]],
                ["word", "known", "base", "lattice", *sums],
            ).to_batches(max_chunksize=10_000)

    rated = scratch.keep(counts.mapInArrow(lattices, "word binary, known long, base double, lattice double, " + ", ".join(f"{s} double" for s in sums)))
    every = sum((F.col(n) for n in names), F.lit(0))
    uses = max(1, model.tokens // HOT_WORDS)
    short = counts.where((every > 0) & ((F.octet_length("word") <= HOT_BYTES) | (every > uses))).withColumn("n", every)
    top = heaviest(short, "n", HOT_WORDS).collect()
    words = [bytes(r["word"]) for r in top]
    hot = (words, np.array([[r[n] for n in names] for r in top], dtype=float).reshape(len(top), n_classes))
    hot_shared = spark.sparkContext.broadcast(hot)
    fields = "doc_id long, held_out boolean, row long, word binary, tf long, n_tokens long, n_known long, base double, lattice double, " + ", ".join(f"{s} double" for s in sums)
    loaded: dict = {}

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, lp, m = shared.value
        key = id(hot_shared)
        if key not in loaded:
            hot_words, got = hot_shared.value
            z = log_likelihood(hot_words, p, lp)
            logs = _word_scores(m, got, z)
            total = got.sum(axis=1)
            loaded[key] = ({w: i for i, w in enumerate(hot_words)}, (total > 0).astype(np.int64), _base(m, total), z, logs)
        index, known, base, z, logs = loaded[key]
        end_base = float(_base(m, np.array([float(m.docs)]))[0])
        end_known = int(m.docs > 0)
        end = m.end_log_p()
        for batch in batches:
            n, n_known, at_base, at_z, at_sums = [], [], [], [], []
            cold, tfs, owners = [], [], []
            for row, text in zip(batch.column(3).to_pylist(), batch.column(1).to_pylist()):
                ws = words_of(text)
                at = list(map(index.get, ws))
                if None in at:
                    rest = Counter([w for w, a in zip(ws, at) if a is None])
                    cold += rest.keys()
                    tfs += rest.values()
                    owners.append(np.full(len(rest), row))
                    at = [a for a in at if a is not None]
                hits = np.array(at, dtype=np.int64)
                n.append(len(ws) + 1)
                n_known.append(int(known[hits].sum()) + end_known)
                at_base.append(float(base[hits].sum()) + end_base)
                at_z.append(float(z[hits].sum()))
                at_sums.append(logs[hits].sum(axis=0) + end)
            d, m = batch.num_rows, len(cold)
            s = np.array(at_sums).reshape(d, n_classes)

            def column(values, kind: pa.DataType, tail: pa.Array | None = None) -> pa.Array:
                head = values if isinstance(values, pa.Array) else pa.array(values, kind)
                return pa.concat_arrays([head.cast(kind), tail if tail is not None else pa.nulls(m, kind)])

            yield pa.RecordBatch.from_arrays(
                [
                    column(batch.column(0), pa.int64()), column(batch.column(2), pa.bool_()),
                    column(batch.column(3), pa.int64(), pa.array(np.concatenate(owners) if owners else [], pa.int64())),
                    column(pa.nulls(d, pa.binary()), pa.binary(), pa.array(cold, pa.binary())), column(np.zeros(d, np.int64), pa.int64(), pa.array(tfs, pa.int64())),
                    column(n, pa.int64()), column(n_known, pa.int64()), column(at_base, pa.float64()), column(at_z, pa.float64()), *[column(s[:, k], pa.float64()) for k in range(n_classes)],
                ],
                ["doc_id", "held_out", "row", "word", "tf", "n_tokens", "n_known", "base", "lattice", *sums],
            )

    numbered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "held_out", F.monotonically_increasing_id().alias("row"))
    seen = scratch.keep(numbered.mapInArrow(look_up, fields))
    whole = seen.where("word is null").select("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "lattice", *sums)
    rare = seen.where("word is not null").select("row", "word", "tf").join(rated.hint("merge"), "word")
    tf = F.col("tf")
    rare = rare.groupBy("row").agg(F.sum(F.col("known") * tf).alias("n_known"), F.sum(F.col("base") * tf).alias("base"), F.sum(F.col("lattice") * tf).alias("lattice"), *[F.sum(F.col(s) * tf).alias(s) for s in sums])
    rare = rare.select("row", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("boolean").alias("held_out"), F.lit(0).cast("long").alias("n_tokens"), "n_known", "base", "lattice", *sums)
    added = whole.unionByName(rare).groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "lattice", *sums)]
    )
    prior = model.prior()
    joint = [F.col(s) + F.lit(float(prior[k])) for k, s in enumerate(sums)]
    most = F.greatest(*joint) if n_classes > 1 else joint[0]
    total = most + F.log(sum((F.exp(j - most) for j in joint), F.lit(0.0)))
    return added.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), (total / math.log(10)).alias("score"), (F.col("lattice") / math.log(10)).alias("lattice_score"),
    )


def _base(model: Model, count: np.ndarray) -> np.ndarray:
    return model.base(count)


def _word_scores(model: Model, counts: np.ndarray, log_z: np.ndarray) -> np.ndarray:
    """Word scores by class; without training rows what the pieces give."""
    if model.tokens == 0:
        return np.repeat(log_z[:, None], counts.shape[1], axis=1)
    return model.word_log_p(counts, log_z)
