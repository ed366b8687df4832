"""Temperature mixing of sources: shares to a power, then budgeted block permutations."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, ordered

#: exponents tried in one pass over the sources' table; each pass gains log2(TRIES + 1) bits
TRIES = 15
PASSES = 10


@dataclass(frozen=True)
class Mixture:
    """What was solved for: the exponent, the mixture's entropy in nats, and tokens to deal out."""

    exponent: float
    entropy: float
    budget: float


def tokens_of(text: Column) -> Column:
    """Words between blanks; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_sizes(docs: DataFrame) -> DataFrame:
    """(source, tokens, rows) of a table of (doc_id, source, n_tokens)."""
    return docs.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows"))


def _measure(sizes: DataFrame, exponents: list[float]) -> list[tuple[float, float, float, float]]:
    """For each exponent: the weights' sum, their entropy, and the largest and smallest weight per token."""
    top = float(sizes.agg(F.max("tokens")).first()[0])
    with_tokens = sizes.where("tokens > 0").withColumn("x", F.log(F.col("tokens") / F.lit(top)))
    aggs = []
    for k, a in enumerate(exponents):
        u = F.exp(F.lit(a) * F.col("x"))
        per = F.exp(F.lit(a - 1.0) * F.col("x"))
        aggs += [F.sum(u).alias(f"z{k}"), F.sum(u * F.col("x") * a).alias(f"s{k}"), F.max(per).alias(f"hi{k}"), F.min(per).alias(f"lo{k}")]
    r = with_tokens.agg(*aggs).first()
    return [(r[f"z{k}"], math.log(r[f"z{k}"]) - r[f"s{k}"] / r[f"z{k}"], r[f"hi{k}"] / r[f"z{k}"], r[f"lo{k}"] / r[f"z{k}"]) for k in range(len(exponents))]


def _bisect(sizes: DataFrame, good) -> float:
    """The largest exponent in [0, 1] for which good(measures) still fails to hold above it: good holds at and below it.

    good must hold for small exponents and fail for large ones, as entropy does.
    """
    ends = _measure(sizes, [0.0, 1.0])
    if good(ends[1]):
        return 1.0
    if not good(ends[0]):
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(PASSES):
        step = (high - low) / (TRIES + 1)
        tries = [low + step * (k + 1) for k in range(TRIES)]
        held = [good(m) for m in _measure(sizes, tries)]
        n = held.index(False) if False in held else TRIES
        low, high = (tries[n - 1] if n else low), (tries[n] if n < TRIES else high)
    return low


def solve(sizes: DataFrame, entropy_share: float | None = None, max_repeats: float | None = None, budget: float | None = None) -> Mixture:
    """Exponent and budget for a table (source, tokens, rows).

    entropy_share: the mixture's entropy is to reach this share of the largest
    possible (log of the number of sources); the exponent is the largest that does.
    max_repeats: no source may be read more often than this.  The exponent is then
    the smallest that keeps the limit.  With a budget, tokens to deal out; without
    one it is the least for which every source is read once in full at least, so
    no row is lost.  If both targets are given the repetition limit wins.
    """
    n = sizes.where("tokens > 0").count()
    if not n:
        return Mixture(1.0, 0.0, 0.0)
    top = sizes.agg(F.max("tokens")).first()[0]
    exponent = 1.0
    if entropy_share is not None:
        exponent = _bisect(sizes, lambda m: m[1] >= entropy_share * math.log(n) - 1e-12)
    if max_repeats is not None:
        # weight / tokens is `per / top`: repeats of a source are budget * per / top
        def too_often(m):
            reads = budget * m[2] / top if budget is not None else m[2] / m[3]
            return reads > max_repeats * (1 + 1e-9)

        kept = _bisect(sizes, too_often)
        exponent = max(exponent, kept) if entropy_share is not None else kept
        if exponent < 1.0 and too_often(_measure(sizes, [exponent])[0]):
            exponent = min(1.0, exponent + 2.0 ** -38)
    z, entropy, _, least = _measure(sizes, [exponent])[0]
    return Mixture(exponent, entropy, float(budget) if budget is not None else top / least)


def mix(docs: DataFrame, mixture: Mixture, sizes: DataFrame, blocks: int, seed: int, scratch: Scratch) -> DataFrame:
    """Deal out the budget: one row for each time a document is read.

    docs: (doc_id, source, n_tokens), and further columns that are carried along.  A source with weight w gets budget * w
    tokens: whole readings of all its documents, and for the rest those that come
    first in the source's permutation and still fit whole.  Returns doc_id,
    source, n_tokens, weight, epoch (0, 1, ...) and block: the budget is cut into
    `blocks` blocks, each of which holds every source at its weight, in the
    order `place` (a hash).  A source without tokens has weight 0 and its rows
    are read once, in block 0 (so empty texts are not lost); a null source is a
    source of its own; rows that repeat are read as rows of their own.

    Token sums run over range-dealt stretches, so a source that holds a third of
    all rows is spread over as many tasks as its rows need.
    """
    top = sizes.agg(F.max("tokens")).first()[0] or 1
    u = F.when(F.col("tokens") > 0, F.exp(F.lit(mixture.exponent) * F.log(F.col("tokens") / F.lit(float(top))))).otherwise(0.0)
    raw = sizes.select("source", "tokens", u.alias("u"))
    total = raw.agg(F.sum("u")).first()[0] or 1.0
    weights = raw.select(F.col("source").alias("_source"), "tokens", (F.col("u") / F.lit(total)).alias("weight")).withColumn("quota", F.col("weight") * F.lit(mixture.budget)).withColumn(
        "full", F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens") + F.lit(1e-9))).otherwise(F.lit(1))
    ).withColumn("rest", F.when(F.col("tokens") > 0, F.greatest(F.lit(0.0), F.col("quota") - F.col("full") * F.col("tokens"))).otherwise(0.0))
    keyed = docs.withColumn("place", F.xxhash64(F.lit(seed), "source", "doc_id"))
    rows, _ = ordered(keyed, ["source"], ["place", "doc_id", "n_tokens"], scratch)
    inside = Window.partitionBy("_part", "source").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("_part", "source").agg(F.sum("n_tokens").alias("_tokens"))
    starts = parts.select(F.col("_part").alias("_p"), F.col("source").alias("_s"), F.coalesce(F.sum("_tokens").over(before), F.lit(0)).alias("_before"))
    summed = rows.withColumn("_upto", F.sum("n_tokens").over(inside))
    placed = summed.join(starts, (F.col("_part") == F.col("_p")) & F.col("source").eqNullSafe(F.col("_s"))).withColumn("upto", F.col("_upto") + F.col("_before"))
    known = placed.join(weights, F.col("source").eqNullSafe(F.col("_source")))
    reads = (F.col("full") + F.when(F.col("upto") <= F.col("rest"), 1).otherwise(0)).cast("int")
    dealt = known.withColumn("reads", reads).where("reads > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("reads") - 1)))
    done = F.col("epoch") * F.col("tokens") + F.col("upto") - F.col("n_tokens")
    block = F.when(F.col("quota") > 0, F.least(F.lit(blocks - 1), F.floor(done / F.col("quota") * blocks))).otherwise(0)
    more = [c for c in docs.columns if c not in ("doc_id", "source", "n_tokens")]
    return dealt.select("doc_id", "source", "n_tokens", *more, "weight", "epoch", block.cast("int").alias("block"), F.xxhash64(F.lit(seed), "epoch", "doc_id").alias("place"))
