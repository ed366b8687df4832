"""Near-duplicate vectors by a forest of random-projection trees with spill overlap."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, small_batches

TREES = 6
#: rows that a leaf is to hold, and the share of a node's rows that goes to both sides of a split
LEAF_ROWS, SPILL = 1000, 0.1
#: rows the splits are drawn from, and their bytes, at most
SAMPLE_ROWS, SAMPLE_BYTES = 20_000, 64 << 20
#: sample rows in a leaf at least; leaves that hold too many rows then are split again from samples of their own
LEAF_SAMPLE = 16
#: random directions tried for a split, and the share of a node's linked sample pairs that a split may part at most
TRIES, PARTED = 6, 0.04
#: linked sample pairs that splits are judged by, at most
SAMPLE_LINKS = 60_000
#: leaves' worth of rows from which on a leaf is split again, the rows its own sample has, and the most leaves that makes
SPLIT_FROM, SPLIT_SAMPLE, MORE_LEAVES = 4, 4000, 1 << 12
#: rows of a clump that make it a hot one (in leaves' worth; and sample rows at least)
HOT_LEAVES, HOT_SAMPLE = 4, 12
#: rows of a clump, of its visitors, or of a dense leaf, that are compared in one task
BLOCK = 4096


@dataclass
class Node:
    direction: int = -1
    low: float = 0.0  # rows at or above go right
    high: float = 0.0  # rows at or below go left
    left: int = -1
    right: int = -1
    leaf: int = -1


@dataclass
class Forest:
    """Splits of all trees, and the centres of hot clumps."""

    threshold: float
    dim: int
    directions: np.ndarray
    trees: list[list[Node]] = field(default_factory=list)
    centres: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    @property
    def radius(self) -> float:
        """Angle to a centre within which any two rows are linked for certain."""
        return math.acos(self.threshold) / 2 - 1e-6

    def leaves(self, x: np.ndarray) -> list[list[list[int]]]:
        """By tree and row: the leaves that the row is in, rising."""
        dim = min(self.dim, x.shape[1])
        seen = x[:, :dim] @ self.directions[:, :dim].T if len(x) else np.zeros((0, len(self.directions)))
        out = []
        for nodes in self.trees:
            found: list[list[int]] = [[] for _ in range(len(x))]
            stack = [(0, np.arange(len(x)))]
            while stack:
                at, rows = stack.pop()
                if not len(rows):
                    continue
                node = nodes[at]
                if node.leaf >= 0:
                    for r in rows:
                        found[r].append(node.leaf)
                    continue
                p = seen[rows, node.direction]
                stack.append((node.left, rows[p <= node.high]))
                stack.append((node.right, rows[p >= node.low]))
            out.append([sorted(f) for f in found])
        return out


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, safe for very large and very small components."""
    x = x.astype(np.float64)
    top = np.abs(x).max(axis=1, keepdims=True)
    x = x / top
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def sample_links(x: np.ndarray, threshold: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows at or above the threshold (SAMPLE_LINKS of them at most, drawn at random), and each row's number of them."""
    pairs, counts, small = [], np.zeros(len(x), np.int64), x.astype(np.float32)
    for at in range(0, len(x), 1024):
        a, b = np.nonzero(small[at : at + 1024] @ small.T >= threshold)
        a += at
        counts[at : at + 1024] = np.bincount(a - at, minlength=min(1024, len(x) - at)) - 1
        keep = np.flatnonzero(a < b)
        if len(keep) > SAMPLE_LINKS:
            keep = rng.choice(keep, SAMPLE_LINKS, replace=False)
        pairs.append(np.stack([a[keep], b[keep]], axis=1))
    every = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)
    if len(every) > SAMPLE_LINKS:
        every = every[rng.choice(len(every), SAMPLE_LINKS, replace=False)]
    return every[:, 0], every[:, 1], counts


def split(own: np.ndarray, links: tuple[np.ndarray, np.ndarray], rng: np.random.Generator) -> tuple[np.ndarray, float, float] | None:
    """The random direction and cut, of TRIES times 5, that part the fewest linked pairs of a node's sample rows (numbers into `own`).

    None if all part more than a share PARTED of them (the node is one clump, which is to stay whole), or if rows can't be told apart.
    """
    a, b = links
    best: tuple[float, np.ndarray, float, float] | None = None
    for _ in range(TRIES):
        v = rng.standard_normal(own.shape[1])
        v /= np.linalg.norm(v)
        p = own @ v
        for middle in rng.uniform(0.3, 0.7, 5):
            low, high = np.quantile(p, [middle - SPILL / 2, middle + SPILL / 2])
            if max((p <= high).sum(), (p >= low).sum()) >= 0.95 * len(own):
                continue
            parted = (((p[a] < low) & (p[b] > high)) | ((p[b] < low) & (p[a] > high))).mean() if len(a) else 0.0
            if best is None or parted < best[0]:
                best = (parted, v, float(low), float(high))
        if best is not None and best[0] == 0.0:
            break
    return best[1:] if best is not None and best[0] <= PARTED else None


def grow_tree(rows: np.ndarray, links: tuple[np.ndarray, np.ndarray], size: float, rng: np.random.Generator, directions: list[np.ndarray]) -> list[Node]:
    """One tree over sample rows, down to nodes of `size` of them or to clumps; directions are added to those given."""
    nodes, leaves = [Node()], 0
    stack = [(0, np.arange(len(rows)), links)]
    while stack:
        at, own, (a, b) = stack.pop()
        node = nodes[at]
        place = np.full(len(rows), -1)
        place[own] = np.arange(len(own))
        cut = split(rows[own], (place[a], place[b]), rng) if len(own) > size else None
        if cut is None:
            node.leaf = leaves
            leaves += 1
            continue
        v, node.low, node.high = cut
        node.direction = len(directions)
        directions.append(v)
        node.left, node.right = len(nodes), len(nodes) + 1
        nodes += [Node(), Node()]
        p = rows @ v
        for child, side in ((node.left, p[own] <= node.high), (node.right, p[own] >= node.low)):
            inside = np.zeros(len(rows), bool)
            inside[own[side]] = True
            keep = inside[a] & inside[b]
            stack.append((child, own[side], (a[keep], b[keep])))
    return nodes


def grow(sample: np.ndarray, rows: int, threshold: float, seed: int, trees: int = TREES, clumps: bool = True, leaf_rows: int = LEAF_ROWS) -> Forest:
    """Draw the forest from unit rows of a bounded sample, for a table of so many rows."""
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    forest = Forest(threshold, dim, np.zeros((0, dim)))
    free = np.ones(len(sample), bool)
    centres = []
    if clumps:
        near = math.cos(forest.radius)
        least = max(HOT_SAMPLE, HOT_LEAVES * leaf_rows * len(sample) / max(1, rows))
        _, _, counts = sample_links(sample, near, rng)
        for pivot in np.argsort(-counts, kind="stable"):
            if counts[pivot] + 1 < least:
                break
            if not free[pivot]:
                continue
            close = free & (sample @ sample[pivot] >= near)
            if close.sum() >= least:
                centre = sample[close].mean(axis=0)
                centre /= np.linalg.norm(centre)
                inside = free & (sample @ centre >= near)
                if inside.sum() >= least:
                    centres.append(centre)
                    free &= ~inside
    forest.centres = np.array(centres).reshape(len(centres), dim)
    rest = sample[free]
    a, b, _ = sample_links(rest, threshold, rng)
    size = max(LEAF_SAMPLE, leaf_rows * len(sample) / max(1, rows))
    directions: list[np.ndarray] = []
    for _ in range(trees):
        forest.trees.append(grow_tree(rest, (a, b), size, rng, directions))
    forest.directions = np.array(directions).reshape(len(directions), dim)
    return forest


class Labels:
    """Components of a leaf's rows, joined pair by pair of blocks: each row's label is the smallest row number known to be linked."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        n = len(self.of)
        while len(a):
            pairs = np.unique(np.minimum(self.of[a], self.of[b]) * n + np.maximum(self.of[a], self.of[b]))
            low, high = pairs // n, pairs % n
            low, high = low[low < high], high[low < high]
            if not len(low):
                return
            up = np.arange(n)
            np.minimum.at(up, high, low)
            while (up[up] != up).any():
                up = up[up]
            self.of = up[self.of]


def leaf_links(tree: int, leaf: int, ids: np.ndarray, x: np.ndarray, places: list[list[list[int]]], threshold: float, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links inside one leaf: (row, links that are counted here, smallest id linked) of the rows with any.

    A pair that shares several leaves is counted in the first of them alone, by
    tree, then leaf number; places[t][row] are the row's leaves in tree t.  side: of two blocks of a leaf (0 and 1), pairs across alone.
    Rows are compared a stretch at a time, so that linked pairs never stand in memory together.
    """
    n = len(ids)
    counts, labels = np.zeros(n, np.int64), Labels(n)
    before = []
    for t in range(tree + 1):
        rows_in = [[v for v in p if t < tree or v < leaf] for p in places[t]]
        column = {v: k for k, v in enumerate(sorted({v for r in rows_in for v in r}))}
        inside = np.zeros((n, len(column)), bool)
        for k, r in enumerate(rows_in):
            inside[k, [column[v] for v in r]] = True
        shared = inside.sum(axis=0) > 1
        if shared.any():
            before.append(inside[:, shared])
    step = max(64, (1 << 21) // max(1, n))
    for at in range(0, n, step):
        a, b = np.nonzero(x[at : at + step] @ x.T >= threshold)
        a += at
        keep = (a < b) if side is None else (a < b) & (side[a] != side[b])
        a, b = a[keep], b[keep]
        labels.join(a, b)
        first = np.ones(len(a), bool)
        for inside in before:
            some = np.flatnonzero(first)
            for k in range(0, len(some), 1 << 15):
                part = some[k : k + (1 << 15)]
                first[part] = ~(inside[a[part]] & inside[b[part]]).any(axis=1)
        counts += np.bincount(a[first], minlength=n) + np.bincount(b[first], minlength=n)
    low = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(low, labels.of, ids)
    up = low[labels.of]
    some = np.flatnonzero((counts > 0) | (up != ids))
    return some, counts[some], up[some]


_ROUTED = "rid long, vec_id long, kind int, clump int, home int, dim int, vec binary, places array<array<long>>"


def _matrix(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1) if raw else np.zeros((0, 1))


def near_duplicates(vectors: DataFrame, scratch: Scratch, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = 11, leaf_rows: int = LEAF_ROWS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Link vectors whose cosine is at or above threshold: vec_id, n_links, component_id, kept.

    n_links: other rows linked directly; component_id: smallest vec_id reachable;
    kept: vec_id is its component_id.  Every row is indexed; what is fitted on a bounded
    sample (sample_rows) is where the splits lie.  Cosines are computed in double precision
    and no pair below the threshold is linked; pairs that share no leaf in any
    tree are missed (recall is measured in the tests).

    Null, zero and non-finite vectors link with nothing and are their own
    component, and so do vectors with a null component; vectors of different lengths never
    link; rows that repeat a vec_id are rows of their own in n_links; null ids
    stay in the result, are counted and have no component; an empty table
    gives no rows; other columns aren't read.

    Splits are random, but of several the one that parts the fewest linked pairs of the sample is taken, and a
    node that none leaves whole is a clump and is split no more.  Clumps of HOT_LEAVES leaves' worth of rows are set apart: rows within
    half the threshold's angle of such a clump's centre are all linked with each other, so they
    are counted and not compared.  Rows that lie near enough to a clump to be
    linked with some of it are compared with it in blocks of BLOCK x BLOCK.  Leaves
    return a row for each row with links, never pairs.
    """
    spark = scratch.spark
    small_batches(spark)
    given = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"), F.monotonically_increasing_id().alias("rid"))
    finite = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    usable = F.coalesce(F.col("v").isNotNull() & finite & F.exists("v", lambda e: e != 0), F.lit(False))
    rows = scratch.keep(given.select("rid", "vec_id", F.when(usable, F.col("v")).alias("v")))
    good = rows.where("v is not null")
    by_dim = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if by_dim is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    dim, n_rows = by_dim
    limit = max(1, min(sample_rows, SAMPLE_BYTES // (8 * dim)))
    # about limit rows by a hash of the row, at most limit: no task hands over more than its share
    share = min(1.0, 0.97 * limit / n_rows)
    drawn = good.where(F.size("v") == dim) if n_rows <= limit else good.where((F.size("v") == dim) & (F.pmod(F.xxhash64("rid", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30))))
    picked = drawn.select("v").limit(limit).toArrow()
    sample = unit(np.array(picked.column(0).combine_chunks().flatten()).reshape(-1, dim))
    forest = grow(sample, n_rows, threshold, seed, leaf_rows=leaf_rows)
    shared = spark.sparkContext.broadcast(forest)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        near, reach = math.cos(f.radius), math.cos(min(math.pi, math.acos(f.threshold) + f.radius + 1e-6))
        for batch in batches:
            rid, vid = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            vecs = batch.column(2).to_pylist()
            out: list[tuple] = []
            for d in sorted({len(v) for v in vecs}):
                own = [k for k, v in enumerate(vecs) if len(v) == d]
                x = unit(np.array([vecs[k] for k in own]))
                clump = np.full(len(own), -1)
                visits: list[tuple[int, int]] = []
                if d == f.dim and len(f.centres):
                    to = x @ f.centres.T
                    clump = np.where(to.max(axis=1) >= near, to.argmax(axis=1), -1)
                    # a row of clump j visits the clumps behind it alone, so each pair meets once
                    visits = [(int(r), int(c)) for r, c in zip(*np.nonzero(to >= reach)) if c > clump[r]]
                for r, c in visits:
                    out.append((rid[own[r]], vid[own[r]], 3, c, int(clump[r]), d, x[r].tobytes(), None))
                for r in np.flatnonzero(clump >= 0):
                    out.append((rid[own[r]], vid[own[r]], 2, int(clump[r]), 0, d, x[r].tobytes(), None))
                loose = np.flatnonzero(clump < 0)
                found = f.leaves(x[loose])
                for k, r in enumerate(loose):
                    out.append((rid[own[r]], vid[own[r]], 1, -1, 0, d, x[r].tobytes(), [t[k] for t in found]))
            cols = list(zip(*out)) if out else [[]] * 8
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [c.split()[0] for c in _ROUTED.split(", ")])

    routed = scratch.keep(good.select("rid", "vec_id", "v").mapInArrow(route, _ROUTED))
    loose = _split_again(routed.where("kind = 1").select("rid", "vec_id", "dim", "vec", "places"), threshold, seed, leaf_rows, scratch)
    met = scratch.keep(_in_leaves(loose, threshold, scratch))
    clumps = scratch.keep(routed.where("kind = 2").groupBy("clump").agg(F.count("*").alias("size"), F.min("vec_id").alias("low")))
    visited = {r[0]: r[1] for r in routed.where("kind = 3").groupBy("clump").count().collect()}
    counts, edges = met.select("rid", "n"), met.where("node <> up").select(F.col("node").alias("a"), F.col("up").alias("b"))
    if visited:
        crossed = _visits(routed, visited, {r[0]: r[1] for r in clumps.collect()}, threshold, scratch)
        lows = F.broadcast(clumps.select(F.col("clump").alias("_c"), "low"))
        counts = counts.union(crossed.select("rid", "n"))
        own = crossed.where("n > 0 and visitor").join(lows, F.col("clump") == F.col("_c")).drop("_c").withColumnRenamed("low", "b")
        # a visitor from a clump stands for that clump's smallest id
        own = own.join(F.broadcast(clumps.select(F.col("clump").alias("_f"), F.col("low").alias("from_low"))), F.col("home") == F.col("_f"), "left")
        edges = edges.union(own.select(F.coalesce("from_low", "vec_id").alias("a"), "b"))
    comps = components(edges, scratch)
    totals = scratch.keep(counts.groupBy("rid").agg(F.sum("n").alias("n")))
    home = routed.where("kind = 2").select("rid", "clump").join(F.broadcast(clumps), "clump").select("rid", "size", "low")
    out = rows.select("rid", "vec_id").join(home, "rid", "left").join(totals, "rid", "left").withColumn("node", F.coalesce("low", "vec_id"))
    out = out.join(comps, "node", "left")
    comp = F.coalesce("component", "node")
    n = F.coalesce("n", F.lit(0)) + F.coalesce(F.col("size") - 1, F.lit(0))
    comp = F.when(F.col("vec_id").isNotNull(), comp)
    return out.select("vec_id", n.cast("long").alias("n_links"), comp.alias("component_id"), F.coalesce(F.col("vec_id") == comp, F.lit(False)).alias("kept"))


def _leaf_sizes(loose: DataFrame) -> DataFrame:
    """(tree, leaf, dim, m): rows of each leaf."""
    trees = loose.select("dim", F.posexplode("places").alias("tree", "leaves"))
    return trees.select("tree", F.explode("leaves").alias("leaf"), "dim").groupBy("tree", "leaf", "dim").agg(F.count("*").alias("m"))


def _split_again(loose: DataFrame, threshold: float, seed: int, leaf_rows: int, scratch: Scratch) -> DataFrame:
    """loose rows with leaves that hold too many of them split by directions fitted on samples of their own rows, in rounds.

    A round cuts leaves of any size down by the sample's worth (SPLIT_SAMPLE / LEAF_SAMPLE times) and the number of rounds grows with the log of the
    table.  Leaves whose sample can't be split without parting linked rows are clumps and stay.
    """
    done = None
    while True:
        sizes = _leaf_sizes(loose).where(F.col("m") > SPLIT_FROM * leaf_rows)
        sizes = scratch.keep(sizes.join(done, ["tree", "leaf", "dim"], "left_anti") if done is not None else sizes)
        if not sizes.limit(1).count():
            return loose
        trees = loose.select("rid", "dim", "vec", F.posexplode("places").alias("tree", "leaves"))
        inside = trees.select("rid", "dim", "vec", "tree", F.explode("leaves").alias("leaf")).join(sizes, ["tree", "leaf", "dim"])
        picked = inside.where(F.pmod(F.xxhash64("rid", "tree", F.lit(seed)), F.lit(1 << 30)) < F.least(F.lit(1.0), F.lit(SPLIT_SAMPLE) / F.col("m")) * (1 << 30))

        def fit(key: tuple, table: pa.Table) -> pa.Table:
            tree, leaf, dim = (k.as_py() for k in key)
            sample = _matrix(table.column("vec").to_pylist())
            forest = grow(sample, table.column("m")[0].as_py(), threshold, seed + 31 * tree + leaf % 1_000_003, 1, clumps=False, leaf_rows=leaf_rows)
            blob = pickle.dumps(forest) if len(forest.trees[0]) > 1 else None
            return pa.table({"tree": pa.array([tree], pa.int32()), "leaf": [leaf], "dim": pa.array([dim], pa.int32()), "forest": pa.array([blob], pa.binary())})

        fitted = scratch.keep(picked.select("tree", "leaf", "dim", "vec", "m").groupBy("tree", "leaf", "dim").applyInArrow(fit, "tree int, leaf long, dim int, forest binary"))
        whole = fitted.where("forest is null").select("tree", "leaf", "dim")
        done = scratch.keep(whole if done is None else done.union(whole))
        cut = fitted.where("forest is not null").join(sizes, ["tree", "leaf", "dim"]).withColumn("parts", F.ceil(F.col("m") / (4 * BLOCK)).cast("int"))

        def apply(key: tuple, rows: pa.Table, forests: pa.Table) -> pa.Table:
            if not rows.num_rows or not forests.num_rows:
                return pa.table({"rid": pa.array([], pa.int64()), "tree": pa.array([], pa.int32()), "leaf": pa.array([], pa.int64()), "subs": pa.array([], pa.list_(pa.int64()))})
            tree, leaf = key[0].as_py(), key[1].as_py()
            found = pickle.loads(forests.column("forest")[0].as_py()).leaves(_matrix(rows.column("vec").to_pylist()))[0]
            subs = [[(leaf + 1) * MORE_LEAVES + v for v in f] for f in found]
            n = rows.num_rows
            return pa.table({"rid": rows.column("rid"), "tree": pa.array([tree] * n, pa.int32()), "leaf": pa.array([leaf] * n, pa.int64()), "subs": pa.array(subs, pa.list_(pa.int64()))})

        dealt = inside.join(cut.select("tree", "leaf", "dim", "parts"), ["tree", "leaf", "dim"]).select("tree", "leaf", "dim", "rid", "vec", F.pmod(F.xxhash64("rid"), "parts").cast("int").alias("part"))
        copies = cut.select("tree", "leaf", "dim", "forest", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        keys = ["tree", "leaf", "dim", "part"]
        moved = dealt.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInArrow(apply, "rid long, tree int, leaf long, subs array<long>")
        by_row = moved.groupBy("rid").agg(F.collect_list(F.struct("tree", "leaf", "subs")).alias("moved"))

        def replaced(leaves, t):
            return F.array_sort(F.flatten(F.transform(leaves, lambda leaf: F.coalesce(F.get(F.filter("moved", lambda m: (m["tree"] == t) & (m["leaf"] == leaf)), F.lit(0))["subs"], F.array(leaf)))))

        both = loose.join(by_row, "rid", "left")
        loose = scratch.keep(both.select("rid", "vec_id", "dim", "vec", F.when(F.col("moved").isNull(), F.col("places")).otherwise(F.transform("places", replaced)).alias("places")))


def _in_leaves(loose: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """(rid, node, n, up): links counted in leaves; large leaves, which are clumps, in blocks of BLOCK x BLOCK rows."""
    large = scratch.keep(_leaf_sizes(loose).where(F.col("m") > 2 * BLOCK).select("tree", "leaf", "dim", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")))
    trees = loose.select("rid", "vec_id", "dim", "vec", "places", F.posexplode("places").alias("tree", "leaves"))
    rows = trees.select("rid", "vec_id", "dim", "vec", "tree", F.slice("places", F.lit(1), F.col("tree") + 1).alias("places"), F.explode("leaves").alias("leaf"))
    if large.limit(1).count():
        sized = rows.join(large, ["tree", "leaf", "dim"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        mine = F.pmod(F.xxhash64("rid"), "blocks").cast("int")
        rows = sized.withColumn("_mine", mine).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = rows.withColumn("lo", F.least("_mine", "_other")).withColumn("hi", F.greatest("_mine", "_other")).withColumn("upper", F.col("_mine") == F.col("hi")).drop("_mine", "_other", "blocks")
    else:
        rows = rows.select("*", F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(True).alias("upper"))

    def in_leaf(key: tuple, table: pa.Table) -> pa.Table:
        tree, leaf, _, lo, hi = (k.as_py() for k in key)
        rid = table.column("rid").to_numpy()
        ids = table.column("vec_id").fill_null(-(1 << 63)).to_numpy()
        by_row = table.column("places").to_pylist()
        side = table.column("upper").to_numpy() if lo != hi else None
        some, counts, up = leaf_links(tree, leaf, ids, _matrix(table.column("vec").to_pylist()), [[p[t] for p in by_row] for t in range(tree + 1)], threshold, side)
        return pa.table({"rid": rid[some], "node": ids[some], "n": counts, "up": up})

    return rows.groupBy("tree", "leaf", "dim", "lo", "hi").applyInArrow(in_leaf, "rid long, node long, n long, up long")


def _visits(routed: DataFrame, visitors: dict[int, int], members: dict[int, int], threshold: float, scratch: Scratch) -> DataFrame:
    """Links between clumps' rows and the rows near them: (rid, vec_id, clump, home, visitor, n)."""
    spark = scratch.spark
    grid = [(c, max(1, math.ceil(members[c] / BLOCK)), max(1, math.ceil(n / BLOCK))) for c, n in visitors.items()]
    grid = F.broadcast(spark.createDataFrame(grid, "_c int, blocks int, guests int"))
    both = routed.where("kind in (2, 3)").select("rid", "vec_id", "kind", "clump", "home", "vec").join(grid, F.col("clump") == F.col("_c"))
    member = F.col("kind") == 2
    mine = F.pmod(F.xxhash64("rid"), F.when(member, F.col("blocks")).otherwise(F.col("guests")))
    spread = both.withColumn("_mine", mine).withColumn("_other", F.explode(F.sequence(F.lit(0), F.when(member, F.col("guests")).otherwise(F.col("blocks")) - 1)))
    spread = spread.withColumn("_m", F.when(member, F.col("_mine")).otherwise(F.col("_other"))).withColumn("_g", F.when(member, F.col("_other")).otherwise(F.col("_mine")))

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        x = _matrix(table.column("vec").to_pylist())
        a, b = np.flatnonzero(kind == 2), np.flatnonzero(kind == 3)
        linked = x[a] @ x[b].T >= threshold
        n = np.zeros(len(kind), np.int64)
        n[a], n[b] = linked.sum(axis=1), linked.sum(axis=0)
        some = np.flatnonzero(n)
        picked = table.take(pa.array(some))
        return pa.table({"rid": picked["rid"], "vec_id": picked["vec_id"], "clump": picked["clump"], "home": picked["home"], "visitor": pa.array(kind[some] == 3), "n": pa.array(n[some])})

    return scratch.keep(spread.select("rid", "vec_id", "kind", "clump", "home", "vec", "_m", "_g").groupBy("clump", "_m", "_g").applyInArrow(compare, "rid long, vec_id long, clump int, home int, visitor boolean, n long"))
