"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context-window scores."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small_batches

_WORD = re.compile(r"\w+")
#: rounds of term search, each over the toxic rows that no term has hit yet
ROUNDS = 4
#: share of a round's best evidence that its terms have at least: words that merely stand in the same
#: toxic rows are explained by then, and don't come up again over the rows that are left
TIER = 0.25
#: times as frequent in toxic rows as in others that a term is at least, quotations of it not counted
PURITY = 20
#: lengths of the word beginnings that are tried as terms of their own, for families of forms
STEMS = (4, 5, 6, 7, 8)
#: labelled rows that a model is learned from, at most: those that come first by a hash of their id
TRAIN_ROWS = 40_000
#: words to either side of a hit that are looked at for signs of quotation
WINDOW = 6
#: fixed values: words that report somebody else's words, in the languages of the corpus
REPORTING = frozenset("said says quote quoted quotes called calls wrote term word words sagte schrieb zitat wort dit écrit mot citation dijo escribió palabra cita".split())
_QUOTES = "\"“”„«»‘’'`"


def edits_for(term: str) -> int:
    """Edits within which a misspelling counts: none in short terms, two in long ones."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Lexicon:
    """Terms in a trie; `match` walks it together with the word's Levenshtein automaton.

    A state of the automaton is the row of edit distances between the word and
    the path walked so far, cut off above the limit; a branch ends where no cell is within it.
    A word can only be within d edits of a term if it holds one of the term's
    d + 1 parts (the first at its beginning, the last at its end), so words without any are
    settled before the walk.  Stems match every word that begins with them, and the forms
    behind them (form: stem) stand in the trie beside the terms, for their misspellings.
    """

    def __init__(self, terms: dict[str, float], stems: dict[str, float], forms: dict[str, str] | None = None):
        self.terms, self.stems, self.forms = terms, stems, forms or {}
        self.trie: dict = {0: 0}  # under 0: most edits of the terms below
        # part: lengths of the words that may hold it, as bits; inner parts with their place
        self.heads: dict[str, int] = {}
        self.tails: dict[str, int] = {}
        self.inner: dict[tuple[str, int], int] = {}
        for t in terms.keys() | self.forms.keys():
            if d := edits_for(t):
                node = self.trie
                node[0] = max(node[0], d)
                for c in t:
                    node = node.setdefault(c, {0: 0})
                    node[0] = max(node[0], d)
                node[""] = t
                cuts = [len(t) * k // (d + 1) for k in range(d + 2)]
                lengths = sum(1 << n for n in range(len(t) - d, len(t) + d + 1))
                self.heads[t[: cuts[1]]] = self.heads.get(t[: cuts[1]], 0) | lengths
                self.tails[t[cuts[-2] :]] = self.tails.get(t[cuts[-2] :], 0) | lengths
                for a, b in zip(cuts[1:-1], cuts[2:-1]):
                    for i in range(a - d, a + d + 1):
                        self.inner[t[a:b], i] = self.inner.get((t[a:b], i), 0) | lengths
        self.head_lengths, self.tail_lengths = sorted({len(p) for p in self.heads}), sorted({len(p) for p in self.tails})
        self.inner_places = sorted({(i, len(p)) for p, i in self.inner})
        self.stem_lengths = sorted({len(s) for s in stems})
        self.known: dict[str, tuple[str, int] | None] = {}

    def match(self, word: str) -> tuple[str, int] | None:
        """The nearest term and its distance (0: the term or stem itself), or None."""
        try:
            return self.known[word]
        except KeyError:
            pass
        if word in self.terms:
            found = (word, 0)
        else:
            found = None
            for n in self.stem_lengths:
                if len(word) >= n and word[:n] in self.stems:
                    found = (word[:n] + "*", 0)
                    break
            if found is None and len(word) >= 4 and self._may(word):
                found = self._walk(word)
        if len(self.known) > 200_000:
            self.known.clear()
        if len(word) <= 64:
            self.known[word] = found
        return found

    def _may(self, word: str) -> bool:
        n = len(word)
        return (
            any(self.heads.get(word[:k], 0) >> n & 1 for k in self.head_lengths)
            or any(self.tails.get(word[-k:], 0) >> n & 1 for k in self.tail_lengths)
            or any(self.inner.get((word[i : i + k], i), 0) >> n & 1 for i, k in self.inner_places)
        )

    def _walk(self, word: str) -> tuple[str, int] | None:
        best: tuple[int, str] | None = None
        n = len(word)
        stack = [(self.trie, list(range(n + 1)))]
        while stack:
            node, row = stack.pop()
            term = node.get("")
            if term is not None and row[n] <= edits_for(term) and abs(len(term) - n) <= row[n] and (best is None or (row[n], term) < best):
                best = (row[n], term)
            for c, below in node.items():
                if c == "" or c == 0:
                    continue
                new = [row[0] + 1]
                low = new[0]
                for i in range(1, n + 1):
                    x = min(row[i] + 1, new[i - 1] + 1, row[i - 1] + (word[i - 1] != c))
                    new.append(x)
                    low = min(low, x)
                if low <= below[0]:
                    stack.append((below, new))
        if best is None:
            return None
        return (best[1] if best[1] in self.terms else self.forms[best[1]] + "*", best[0])


@dataclass
class Hit:
    term: str
    distance: int
    quoted: bool


def _unquoted(low: str) -> set[str]:
    """Words of a lower-cased text that stand in it outside quotation at least once, by the same signs as in `hits_of`."""
    words = _WORD.findall(low)
    every = set(words)
    marks = [k for k, c in enumerate(low) if c in _QUOTES] if any(q in low for q in _QUOTES) else []
    reports = [k for k, w in enumerate(words) if w in REPORTING] if not REPORTING.isdisjoint(every) else []
    if len(marks) < 2 and not reports:
        return every
    n = len(words)
    at = np.arange(n)
    first, last = np.maximum(0, at - WINDOW), np.minimum(n - 1, at + WINDOW)
    starts, ends = np.array([m.span() for m in _WORD.finditer(low)]).reshape(n, 2).T
    left = np.searchsorted(marks, starts) > np.searchsorted(marks, starts[first])
    right = np.searchsorted(marks, ends[last]) > np.searchsorted(marks, ends)
    told = np.zeros(n + 1, np.int64)
    told[1:] = np.cumsum(np.isin(at, reports))
    reported = told[last + 1] - told[first] > told[at + 1] - told[at]
    return {words[k] for k in np.flatnonzero(~(left & right | reported))}


def hits_of(text: str | None, lexicon: Lexicon) -> tuple[list[Hit], int]:
    """Lexicon hits of a whole text with their context, and its number of words."""
    low = (text or "").lower()
    words = _WORD.findall(low)
    match = lexicon.match
    known = lexicon.known
    bad = {w: m for w in set(words) if (m := known[w] if w in known else match(w))}
    if not bad:
        return [], len(words)
    out = []
    spans = [m.span() for m in _WORD.finditer(low)]
    for k, w in enumerate(words):
        if w in bad:
            term, distance = bad[w]
            start, end = spans[k]
            around = words[max(0, k - WINDOW) : k] + words[k + 1 : k + 1 + WINDOW]
            left = low[spans[max(0, k - WINDOW)][0] : start]
            right = low[end : spans[min(len(spans) - 1, k + WINDOW)][1]]
            in_quotes = any(q in left for q in _QUOTES) and any(q in right for q in _QUOTES)
            out.append(Hit(term, distance, in_quotes or any(x in REPORTING for x in around)))
    return out, len(words)


@dataclass
class ToxicityModel:
    """What was learned: terms and stems with their evidence, weights of hits, and the final fit."""

    lexicon: Lexicon
    weights: dict[tuple[str, int, bool], float] = field(default_factory=dict)
    fit: tuple[float, ...] = (-3.0, 1.5, 1.0, 0.5)

    def weight(self, hit: Hit) -> float:
        return self.weights.get((hit.term, hit.distance, hit.quoted), 0.0)

    def features(self, text: str | None) -> tuple[float, float, float]:
        """Strongest hit, all hits, and hits to a word; all 0 without hits."""
        hits, n = hits_of(text, self.lexicon)
        got = [w for w in map(self.weight, hits) if w > 0]
        return (max(got), math.log1p(sum(got)), len(got) / math.sqrt(n)) if got else (0.0, 0.0, 0.0)

    def score(self, text: str | None) -> float:
        x = sum(a * b for a, b in zip(self.fit, (1.0, *self.features(text))))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, x))))


def _evidence(p: Column, n: Column, pos: int, neg: int) -> Column:
    """Likelihood-ratio statistic of a term that is likelier in toxic rows (0 where it isn't)."""
    base = pos / (pos + neg)

    def part(x: Column, share: float) -> Column:
        return F.when(x > 0, x * F.log(x / ((p + n) * F.lit(share)))).otherwise(0.0)

    g = 2 * (part(p, base) + part(n, 1 - base))
    return F.when(p / (p + n) > base, g).otherwise(0.0)


def _terms_of(text: str | None) -> set[str]:
    words = _unquoted((text or "").lower())
    return {"=" + w for w in words} | {str(n) + w[:n] for w in words for n in STEMS if len(w) > n}


def _families(counts: dict[str, int]) -> set[str]:
    """Terms and stems that stand for others too.

    counts: toxic rows of each ("=term", or length and stem).  A stem that has hardly
    more rows than one longer form of it is only that form cut short, and the form stays;
    of the others the shortest stays, and stands for all forms that begin with it.
    """
    stems = {k[1:]: k for k in counts if k[0] != "="}

    def shorter(k: str) -> list[str]:
        return [stems[k[1 : 1 + n]] for n in STEMS if k[1 : 1 + n] in stems and stems[k[1 : 1 + n]] != k]

    under: dict[str, int] = {}
    for k in counts:
        for s in shorter(k):
            under[s] = max(under.get(s, 0), counts[k])
    whole = {s for s in stems.values() if counts[s] > 1.25 * under.get(s, 0)}
    return {k for k in counts if (k in whole or k[0] == "=") and not any(s in whole for s in shorter(k))}


def _forms_of(counted: DataFrame, stems: list[str]) -> dict[str, str]:
    """Words of toxic rows that begin with one of the stems, each with the shortest such stem."""
    if not stems:
        return {}
    wanted = counted.sparkSession.createDataFrame([(s,) for s in stems], "stem string")
    word = F.expr("substring(term, 2)")
    starts = counted.where("term like '=%'").select(word.alias("word"), F.explode(F.array_distinct(F.array(*[F.substring(word, 1, n) for n in STEMS]))).alias("stem"))
    found = starts.join(F.broadcast(wanted), "stem").collect()
    return {r["word"]: r["stem"] for r in sorted(found, key=lambda r: -len(r["stem"]))}


def learn(rows: DataFrame, scratch: Scratch) -> ToxicityModel | None:
    """Learn from rows (text, toxic 0/1); None if one of the labels is missing.

    rows come from `training_rows`, TRAIN_ROWS at most.  Document counts of every
    word and word beginning that stands outside quotation, by label, are made over all of them; those whose
    evidence beats chance over that many trials become terms (so a term that clean rows only quote is learned too), so a lexicon holds no more than the words of TRAIN_ROWS rows.  Misspellings
    are looked for of all terms and of all words of the toxic rows that a stem stands for.
    Weights of hits, by term, distance and context, come from counts over them
    too, and so does the last fit of four numbers.
    """
    small_batches(scratch.spark)
    counts = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    pos, neg = counts.get(1, 0), counts.get(0, 0)
    if not pos or not neg:
        return None

    def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Counter] = {0: Counter(), 1: Counter()}

        def out() -> pa.RecordBatch:
            keys = list(held[0].keys() | held[1].keys())
            batch = pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array([held[1][k] for k in keys], pa.int64()), pa.array([held[0][k] for k in keys], pa.int64())], ["term", "p", "n"]
            )
            held[0].clear()
            held[1].clear()
            return batch

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[toxic].update(_terms_of(text))
            if len(held[0]) + len(held[1]) > 300_000:
                yield out()
        yield out()

    def counts_of(some: DataFrame) -> DataFrame:
        return some.mapInArrow(count_terms, "term string, p long, n long").groupBy("term").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).where("p > 0")

    counted = scratch.keep(counts_of(rows))
    stems: dict[str, float] = {}
    terms: dict[str, float] = {}
    forms: dict[str, str] = {}
    left, in_left = counted, pos
    for _ in range(ROUNDS):
        tried = max(1, left.count())
        strong = (
            left.withColumn("g", _evidence(F.col("p"), F.col("n"), in_left, neg))
            .where((F.col("g") >= 2 * math.log(10 * tried)) & ((F.col("p") + 0.5) * (neg + 1) > PURITY * (F.col("n") + 0.5) * (in_left + 1)))
            .orderBy(F.desc("g"), "term").collect()
        )
        strong = [r for r in strong if r["g"] >= TIER * strong[0]["g"]]
        new = {r["term"]: r["g"] for r in strong}
        kept = _families({r["term"]: r["p"] for r in strong})
        stems |= {t[1:]: g for t, g in new.items() if t[0] != "=" and t in kept}
        terms |= {t[1:]: g for t, g in new.items() if t[0] == "=" and t in kept}
        forms |= _forms_of(counted, [t[1:] for t in kept if t[0] != "="])
        model = ToxicityModel(Lexicon(terms, stems, forms))
        if not new:
            break

        def missed(batches: Iterator[pa.RecordBatch], model: ToxicityModel = model) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not hits_of(t, model.lexicon)[0] for t in batch.column(0).to_pylist()], pa.bool_()))

        # toxic rows without any hit so far, against all others
        rest = scratch.keep(rows.where("toxic = 1").mapInArrow(missed, rows.schema))
        in_left = rest.count()
        if in_left < 3:
            break
        left = scratch.keep(counts_of(rest).select("term", "p").join(counted.select("term", "n"), "term"))

    def count_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for key in {(h.term, h.distance, h.quoted) for h in hits_of(text, model.lexicon)[0]}:
                    held[key, toxic] += 1
        keys = list(held)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0][0] for k in keys], pa.string()), pa.array([k[0][1] for k in keys], pa.int32()), pa.array([k[0][2] for k in keys], pa.bool_()), pa.array([k[1] for k in keys], pa.int32()), pa.array([held[k] for k in keys], pa.int64())],
            ["term", "distance", "quoted", "toxic", "n"],
        )

    # terms, three distances, two contexts and two labels: a bounded table
    seen = rows.mapInArrow(count_hits, "term string, distance int, quoted boolean, toxic int, n long").groupBy("term", "distance", "quoted", "toxic").agg(F.sum("n").alias("n")).collect()
    by_key: dict[tuple[str, int, bool], list[float]] = {}
    by_kind: dict[tuple[int, bool], list[float]] = {(d, q): [0.0, 0.0] for d in (0, 1, 2) for q in (False, True)}
    for r in seen:
        by_key.setdefault((r["term"], r["distance"], r["quoted"]), [0.0, 0.0])[r["toxic"]] += r["n"]
        by_kind[r["distance"], r["quoted"]][r["toxic"]] += r["n"]
    names = list(terms) + [s + "*" for s in stems]
    for t in names:
        for (d, q), (kind_n, kind_p) in by_kind.items():
            n, p = by_key.get((t, d, q), (0.0, 0.0))
            # what the term has shown by itself, with its kind as two rows' worth of prior
            prior = (kind_p + (1.0 if q else 2.0) / (1 + d)) / (kind_p + kind_n + 3.0)
            share = (p + 2 * prior) / (p + n + 2)
            model.weights[t, d, q] = max(0.0, math.log(share / (1 - share)) - math.log(pos / neg))
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [model.features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[pa.array([g[k] for g in got], pa.float64()) for k in range(3)], batch.column(1)], ["a", "b", "c", "toxic"])

    # three numbers and a label for each of TRAIN_ROWS rows at most
    table = rows.mapInArrow(features, "a double, b double, c double, toxic int").collect()
    model.fit = _logistic(np.array([[1.0, r[0], r[1], r[2]] for r in table]), np.array([float(r[3]) for r in table]))
    model.lexicon.known = {}
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Newton's method with a small ridge, which also holds separable rows in bounds."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], 0.05)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


def score_table(docs: DataFrame, model: ToxicityModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every whole text, 0 to 1.

    Null and empty texts score as texts without hits; with no model (a label
    was missing in training) every score is 0; repeated rows repeat; other columns
    aren't read.  One pass, nothing is exchanged; the model is bounded by the words of TRAIN_ROWS rows.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            scores = [m.score(t) if m else 0.0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def training_rows(docs: DataFrame, labels: DataFrame, held_out: Column, scratch: Scratch) -> DataFrame:
    """(text, toxic) of the labelled rows that aren't held out, TRAIN_ROWS at most; their ids are what is broadcast."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").where(~held_out).select(F.col("doc_id").alias("_id"), F.col("toxic").alias("_toxic"))
    known = scratch.keep(known.orderBy(F.xxhash64("_id"), "_id").limit(TRAIN_ROWS))
    return scratch.keep(docs.join(F.broadcast(known), docs["doc_id"] == known["_id"]).select("text", F.col("_toxic").cast("int").alias("toxic")))


def reject(docs: DataFrame, model: ToxicityModel | None, limit: float, text_col: str = "text") -> DataFrame:
    """Rows of docs, with all their columns, that score below the limit; all rows without a model."""
    if model is None:
        return docs
    small_batches(docs.sparkSession)
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            yield batch.filter(pa.array([m.score(t) < limit for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
