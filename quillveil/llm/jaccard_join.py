"""Jaccard self-join of shingle sets by token-combination prefixes.

Tokens are counted over all texts, but for copies that a task has met before.  A set's prefix is taken in one
order of all tokens, by rising count.  Tokens that one set alone has fill places of the prefix but can't
be shared, so most sets need no index entry at all.  Of the others, rare tokens are indexed one by one,
frequent ones in pairs and very frequent ones in threes, for which the prefix is
extended until it still guarantees a common entry.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, heaviest, lookup, small_batches

#: the most heavy tokens that all tasks know
MAX_HEAVY = 1_000_000


class Limits(NamedTuple):
    """Where one way of working gives over to another; results don't depend on them."""

    #: sets that have a token, from which on it is indexed in pairs, and in threes
    pairs_from: int = 64
    threes_from: int = 4096
    #: sets (as a share of all, and in number) from which on a token is a heavy one: it is known to all tasks, so its uses don't meet in one
    heavy_share: float = 1 / 200
    heavy_least: int = 1000
    #: tokens that a task holds before it deals them out, and that are sorted at once
    tokens_at_once: int = 1_000_000
    #: rows of a family, and tokens in all, that are compared in one task
    block: int = 2048
    block_tokens: int = 2_000_000


_P = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]
#: code of the lightest heavy token; those of counted ones are below
_HEAVY_CODE = 200


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _P[0]
    h = (h ^ (h >> np.uint64(29))) * _P[1]
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word shingles of a whole text.

    Words: stretches without [\\x20\\x09-\\x0D] after lower-casing A-Z.  With fewer
    words than the size, the whole sequence is the one shingle; without words, none.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        k = min(size, len(words))
        out = np.full(len(words) - k + 1, len(words) if k < size else 0, np.uint64)
        for i in range(k):
            out = (out + h[i : len(h) - k + 1 + i]) * _P[2 + i % 5] + np.uint64(i)
        return np.unique(_mix(out))


def node_of(tokens: np.ndarray) -> int | None:
    """The set's own hash as a signed number; None without tokens."""
    if not len(tokens):
        return None
    key = xxhash.xxh3_64_intdigest(tokens.tobytes())
    return key - (1 << 64 if key >> 63 else 0)


def least_overlap(n: int, percent: int) -> int:
    """Tokens that a set of n shares at least with any set it is linked to."""
    return (percent * n + 99) // 100


def has_partners(n, percent: int):
    """Whether a set of n tokens can be linked to another set than itself."""
    return 100 * n >= percent * (n + 1)


def level_of(n: int) -> int:
    """0 below 4 tokens, 1 below 32, then a level for each doubling."""
    return 0 if n < 4 else 1 if n < 32 else n.bit_length() - 4


def groups_of(level: int, percent: int) -> tuple[int, int]:
    """Groups that frequent tokens fall into on a level, and the most tokens to a combination.

    A group bears one shared frequent token (and two shared very frequent ones) without a common
    combination; all groups together must bear fewer than linked sets of the level share.
    """
    groups = 1 << max(0, level - 1)
    least = 1 if level == 0 else 4 if level == 1 else 1 << (level + 3)
    spare = least_overlap(least, percent) - 1
    return groups, 3 if 3 * groups <= spare else 2 if groups <= spare else 1


def count_codes(counts: np.ndarray) -> np.ndarray:
    """One byte that rises with the count: 0 for 1, eight steps for each doubling."""
    return np.minimum(_HEAVY_CODE - 1, np.floor(8 * np.log2(counts))).astype(np.uint8)


def signatures(tokens: np.ndarray, codes: np.ndarray, alone: int, percent: int, limits: Limits = Limits()) -> np.ndarray:
    """Index entries of a set: two linked sets have at least one in common.

    tokens, codes: the tokens that other sets have too, and their counts' codes; alone:
    how many tokens no other set has.

    Let two linked sets have no common entry on the level of the smaller one, and take that one of
    their two prefixes that ends first in the order of tokens.  It holds no shared rare token,
    and of each group fewer shared tokens than make a combination.  All others in it are
    missing in the other set, and these are more than the set can spare.
    """
    n = len(tokens) + alone
    spare = n - least_overlap(n, percent)
    order = np.lexsort((tokens, codes))
    tokens, codes = tokens[order], codes[order]
    pairs_from, threes_from = count_codes(np.array([limits.pairs_from, limits.threes_from]))
    rare = int(np.searchsorted(codes, pairs_from))
    need_after_rare = spare + 1 - alone - rare
    with np.errstate(over="ignore"):
        out = [_mix(tokens[: min(rare, max(0, spare + 1 - alone))])]
        if need_after_rare <= 0:
            return out[0]
        for level in range(level_of(least_overlap(n, percent)), level_of(n) + 1):
            groups, most = groups_of(level, percent)
            need, held, found = need_after_rare, defaultdict(list), []
            for t, c in zip(tokens[rare:].tolist(), codes[rare:].tolist()):
                k = min(most, 2 if c < threes_from else 3)
                own = held[k, (t >> 7) % groups]
                if len(own) >= k - 1:
                    need -= 1
                    if k == 1:
                        found.append((t, 0, 0))
                    elif k == 2:
                        found += [(a, t, 0) for a in own]
                    else:
                        found += [(a, b, t) for j, b in enumerate(own) for a in own[:j]]
                own.append(t)
                if not need:
                    break
            if found:
                e = np.array(found, np.uint64)
                out.append(_mix(((e[:, 0] * _P[3] + e[:, 1]) * _P[4] + e[:, 2]) * _P[5] + np.uint64(level + 1)))
    return np.unique(np.concatenate(out))


def _part_and_rest(tokens: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The stretch of the hash range that each token is in, of so many, and 40 bits of its place there."""
    p = np.uint64(parts)
    low = np.uint64(0xFFFFFFFF)
    with np.errstate(over="ignore"):
        part = ((tokens >> np.uint64(32)) * p + (((tokens & low) * p) >> np.uint64(32))) >> np.uint64(32)
        return part.astype(np.int32), (tokens * p) >> np.uint64(24)


def _pack(rest: np.ndarray) -> np.ndarray:
    """40-bit numbers as rows of five bytes."""
    return np.ascontiguousarray(rest.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :5]


def _unpack(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :5] = raw
    return out.reshape(-1).view("<u8")


def _gaps(owner: np.ndarray) -> bytes:
    """Rising 16-bit numbers as differences, low bytes first, then high bytes, which are nearly all 0."""
    return np.ascontiguousarray(np.diff(owner, prepend=0).astype("<u2").view(np.uint8).reshape(-1, 2).T).tobytes()


def _owners(gaps: bytes) -> np.ndarray:
    planes = np.frombuffer(gaps, np.uint8).reshape(2, -1).astype(np.int64)
    return np.cumsum(planes[0] + (planes[1] << 8))


_DEALT = "to_part int, part int, batch long, nodes binary, sizes binary, owners binary, tokens binary, codes binary"
_DEALT_NAMES = [c.split()[0] for c in _DEALT.split(", ")]
_DEALT_TYPES = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 5]


def _rows_of(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Record batches of some MB."""
    at = 0
    while at < len(rows):
        end, size = at, 0
        while end < len(rows) and size < 4 << 20:
            size += sum(len(x) for x in rows[end][3:] if x is not None)
            end += 1
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at:end]), _DEALT_TYPES)], _DEALT_NAMES)
        at = end


def _slices(keys: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Stretches of equal keys in a sorted array."""
    cuts = (np.flatnonzero(np.diff(keys)) + 1).tolist()
    for a, b in zip([0, *cuts], [*cuts, len(keys)]):
        if b > a:
            yield int(keys[a]), slice(a, b)


def _home(batch: int, parts: int) -> int:
    """The partition that a batch of sets comes back to."""
    with np.errstate(over="ignore"):
        return int(_mix(np.array([batch], np.int64).view(np.uint64))[0] % np.uint64(parts))


def _deal(batch: int, sets: list[np.ndarray], nodes: list[int], heavy: np.ndarray, codes: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """A row for each stretch of the hash range: the batch's tokens there, and whose they are, by place in the batch.

    One more row (part -1) goes to the batch's home at once, with its nodes, their sizes, and heavy tokens with codes.
    """
    tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
    part, rest = _part_and_rest(tokens, parts)
    hot = np.zeros(len(tokens), bool)
    ids, hot_codes = np.zeros(0, np.uint64), np.zeros(0, np.uint8)
    if len(heavy):
        at = np.searchsorted(heavy, tokens)
        at[at == len(heavy)] = 0
        hot = heavy[at] == tokens
        ids, hot_codes = (part[hot].astype(np.uint64) << np.uint64(40)) | rest[hot], codes[at[hot]]
    sizes = np.array([len(s) for s in sets], "<u4")
    rows = [(_home(batch, parts), -1, batch, np.array(nodes, np.int64).tobytes(), sizes.tobytes(), _gaps(owner[hot]), ids.tobytes(), hot_codes.tobytes())]
    part, rest, owner = part[~hot], rest[~hot], owner[~hot]
    order = np.argsort(part, kind="stable")
    part, owner, raw = part[order], owner[order], _pack(rest[order])
    rows += [(to, to, batch, None, None, _gaps(owner[s]), raw[s].tobytes(), None) for to, s in _slices(part)]
    yield from _rows_of(rows)


def _codes_of(raw: np.ndarray, at_once: int) -> np.ndarray:
    """The codes of all tokens' counts in one stretch of the hash range, sorted a part at a time."""
    codes = np.zeros(len(raw), np.uint8)
    steps = max(1, -(-len(raw) // at_once))
    top = raw[:, 4]
    for k in range(steps):
        some = np.flatnonzero((top >= 256 * k // steps) & (top < 256 * (k + 1) // steps)) if steps > 1 else np.arange(len(raw))
        if len(some):
            values = _unpack(raw[some])
            order = np.argsort(values)
            values = values[order]
            n = np.diff(np.r_[np.flatnonzero(np.r_[True, values[1:] != values[:-1]]), len(values)])
            codes[some[order]] = np.repeat(count_codes(n), n)
    return codes


def _give_back(batches: Iterator[pa.RecordBatch], parts: int, at_once: int) -> Iterator[pa.RecordBatch]:
    """Count the tokens of a stretch of the hash range, and send those that several sets have back to their batches, with codes."""
    own: list[tuple] = []
    for batch in batches:
        light = pc.greater_equal(batch.column(1), 0)
        other = batch.filter(pc.invert(light))
        if other.num_rows:
            yield other
        some = batch.filter(light)
        own += zip(some.column(1).to_pylist(), some.column(2).to_pylist(), some.column(5).to_pylist(), some.column(6).to_pylist())
    for part in sorted({r[0] for r in own}):
        rows = [r for r in own if r[0] == part]
        raw = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(-1, 5)
        codes, at, out = _codes_of(raw, at_once), 0, []
        for _, batch, gaps, tokens in rows:
            s = slice(at, at + len(tokens) // 5)
            at = s.stop
            kept = codes[s] > 0
            if kept.any():
                out.append((_home(batch, parts), part, batch, None, None, _gaps(_owners(gaps)[kept]), raw[s][kept].tobytes(), codes[s][kept].tobytes()))
        yield from _rows_of(out)


def _assemble(batches: Iterator[pa.RecordBatch], percent: int, limits: Limits) -> Iterator[pa.RecordBatch]:
    """(node, n, tokens, entries) of the sets that need entries; tokens that no other set has are left out."""
    held: dict[int, list[tuple]] = defaultdict(list)
    for batch in batches:
        for _, part, b, *blobs in zip(*(x.to_pylist() for x in batch.columns)):
            held[b].append((part, *blobs))
    for rows in held.values():
        owner = np.concatenate([_owners(r[3]) for r in rows])
        token = np.concatenate([np.frombuffer(r[4], np.uint64) if r[0] < 0 else (np.uint64(r[0]) << np.uint64(40)) | _unpack(np.frombuffer(r[4], np.uint8).reshape(-1, 5)) for r in rows])
        code = np.concatenate([np.frombuffer(r[5], np.uint8) for r in rows])
        head = next(r for r in rows if r[0] < 0)
        nodes, n = np.frombuffer(head[1], np.int64), np.frombuffer(head[2], "<u4").astype(np.int64)
        alone = n - np.bincount(owner, minlength=len(n))
        wanted = (alone <= n - (percent * n + 99) // 100)[owner]
        owner, token, code = owner[wanted], token[wanted], code[wanted]
        order = np.argsort(owner, kind="stable")
        owner, token, code = owner[order], token[order], code[order]
        out: list[tuple] = []
        for k, s in _slices(owner):
            out.append((int(nodes[k]), int(n[k]), np.sort(token[s]).tobytes(), signatures(token[s], code[s], int(alone[k]), percent, limits).view(np.int64)))
            if len(out) == 128:
                yield _sets_batch(out)
                out = []
        if out:
            yield _sets_batch(out)


def _sets_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())))], ["node", "n", "tokens", "entries"])


def connect(n: np.ndarray, tokens: list[np.ndarray], percent: int) -> np.ndarray:
    """A label for each set, equal for those that links connect.

    Sets outside the largest component are compared with all, one by one, until none is
    left that hasn't been; so of two sets with different labels one was compared with the other.
    """
    m = len(n)
    label, done = np.arange(m), np.zeros(m, bool)
    starts = np.r_[0, np.cumsum([len(t) for t in tokens])[:-1]]
    values, at = np.unique(np.concatenate(tokens), return_inverse=True)
    marked = np.zeros(len(values), bool)
    while True:
        main = np.bincount(label, minlength=m).argmax()
        left = np.flatnonzero(~done & (label != main))
        if not len(left):
            return label
        x = left[0]
        own = at[starts[x] : starts[x] + len(tokens[x])]
        marked[own] = True
        common = np.add.reduceat(marked[at].astype(np.int64), starts)
        marked[own] = False
        hit = 100 * common >= percent * (n[x] + n - common)
        hit[x] = True
        met = np.unique(label[hit])
        label[np.isin(label, met)] = met[0]
        done[x] = True


def similar_sets(docs: DataFrame, scratch: Scratch, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """Components of texts whose shingle sets overlap: doc_id, n_shingles, component_id.

    Two texts link when 100 * intersection >= percent * union; all such pairs of
    different sets are found or lie in one component by other verified links.
    component_id: smallest id reachable, of whatever type that can be ordered.  Null texts, and those without words,
    have no shingles and link with nothing; texts of fewer words than the
    size have one shingle; whole texts are read; rows that repeat are linked with
    themselves; a null id has a null component; an empty table gives no
    rows; other columns aren't read.

    Texts with equal sets are one node.  Tokens are dealt by their hash, counted, and
    go back to their sets.  The nodes of an entry belong to the family of the smallest of
    them; each family is compared in one task and gives links, never pairs.
    Families of more than limits.block nodes are compared block by block, each together with the family's smallest node, and
    what these links leave in different components is compared with all blocks.
    Sets are compared by hashes of 40 bits in each of as many stretches as there are shuffle partitions.
    """
    spark = scratch.spark
    small_batches(spark, 500)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        met: set[int] = set()
        n = 0

        def tally(ids: pa.DataType) -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            some = counts >= max(8, limits.heavy_share / 2 * len(held))
            k = int(some.sum())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.nulls(k, ids), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array(values[some].view(np.int64)), pa.array(counts[some])], names)

        names = ["doc_id", "n", "node", "token", "uses"]
        kind = pa.int64()
        for batch in batches:
            sizes, nodes, kind = [], [], batch.column(0).type
            for text in batch.column(1).to_pylist():
                s = shingles(text, size)
                sizes.append(len(s))
                nodes.append(node_of(s))
                if len(s) and nodes[-1] not in met:
                    if len(met) > 1_000_000:
                        met.clear()
                    met.add(nodes[-1])
                    held.append(s)
                    n += len(s)
            d = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.nulls(d, pa.int64()), pa.nulls(d, pa.int64())], names)
            if n > limits.tokens_at_once:
                yield tally(kind)
                n = 0
        if held:
            yield tally(kind)

    seen = scratch.keep(docs.mapInArrow(scan, f"doc_id {id_type}, n long, node long, token long, uses long"))
    rows = seen.where("uses is null").select("doc_id", "n", "node")
    nodes = scratch.keep(rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    heavy_from = max(limits.heavy_least, limits.heavy_share * nodes.count())
    tallied = scratch.keep(seen.where("uses is not null").groupBy("token").agg(F.sum("uses").alias("uses")).where(F.col("uses") >= heavy_from))
    got = heaviest(tallied, "uses", MAX_HEAVY).toArrow().sort_by("token")
    heavy = got["token"].to_numpy().view(np.uint64)
    order = np.argsort(heavy)
    heavy_codes = (_HEAVY_CODE + np.minimum(55, np.log2(np.maximum(1, got["uses"].to_numpy())).astype(np.int64))).astype(np.uint8)
    shared = spark.sparkContext.broadcast((heavy[order], heavy_codes[order]))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, codes = shared.value
        met: set[int] = set()
        sets, own, n = [], [], 0
        number = TaskContext.get().partitionId() << 24
        for batch in batches:
            for text in batch.column(0).to_pylist():
                s = shingles(text, size)
                node = node_of(s)
                if node is None or node in met or not has_partners(len(s), percent):
                    continue
                if len(met) > 1_000_000:
                    met.clear()
                met.add(node)
                sets.append(s)
                own.append(node)
                n += len(s)
                if n > limits.tokens_at_once or len(sets) == 1 << 16:
                    yield from _deal(number, sets, own, tokens, codes, parts)
                    sets, own, n, number = [], [], 0, number + 1
        if sets:
            yield from _deal(number, sets, own, tokens, codes, parts)

    dealt = docs.select("text").mapInArrow(deal, _DEALT).repartitionById(parts, "to_part")
    counted = scratch.keep(dealt.mapInArrow(lambda batches: _give_back(batches, parts, limits.tokens_at_once), _DEALT))
    scratch.release()
    homes = counted.repartitionById(parts, "to_part").mapInArrow(lambda batches: _assemble(batches, percent, limits), "node long, n long, tokens binary, entries array<long>")
    # a set that several batches hold comes from each of them, the same each time
    sets = scratch.keep(homes.dropDuplicates(["node"]))
    scratch.drop(counted)
    comps = components(_links(sets, percent, limits, scratch), scratch)
    low = scratch.keep(comps.join(nodes.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("m")))
    named = lookup(comps, low, "component", "m", F.col("node")).select("node", "component_id")
    heads = nodes.join(named, "node", "left").select("node", "copies", F.coalesce("component_id", "rep").alias("component_id"))
    out = lookup(rows, scratch.keep(heads), "node", "copies", F.xxhash64("doc_id", F.monotonically_increasing_id()))
    comp = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), comp.alias("component_id"))


def _links(sets: DataFrame, percent: int, limits: Limits, scratch: Scratch) -> DataFrame:
    """Links (a, b) that connect all sets with a common entry that overlap enough."""
    entries = sets.select("node", F.explode("entries").alias("entry"))
    leaders = scratch.keep(entries.groupBy("entry").agg(F.min("node").alias("leader"), F.count("*").alias("uses")).where("uses > 1"))
    families = scratch.keep(lookup(entries, leaders, "entry", "uses", F.col("node")).where("leader is not null").select("leader", "node").distinct())
    plain = sets.select("node", "n", "tokens")
    sized = families.join(sets.select("node", "n"), "node").groupBy("leader").agg(F.count("*").alias("m"), F.sum("n").alias("tokens"))
    sized = scratch.keep(sized.select("leader", "m", F.ceil(F.greatest(F.col("m") / limits.block, F.col("tokens") / limits.block_tokens)).cast("long").alias("blocks")))
    dealt = lookup(families, sized, "leader", "m", F.col("node"))
    dealt = scratch.keep(dealt.select("leader", "node", "blocks", F.pmod(F.xxhash64("node"), "blocks").alias("at")))
    rest = F.lit(0).cast("long").alias("guest"), "node", "n", "tokens", F.lit(0).cast("long").alias("component"), F.lit(False).alias("odd")
    others = dealt.where("node <> leader").join(plain, "node").select("leader", "at", *rest)
    # the family's smallest node goes to all of its blocks
    heads = dealt.where("node = leader").join(plain, "node").select("leader", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("at"), *rest)

    def link(key: tuple, table: pa.Table) -> pa.Table:
        node, n = table.column("node").to_numpy(), table.column("n").to_numpy()
        order = np.argsort(node)
        tokens = [np.frombuffer(x.as_buffer(), np.uint64) for c in table.column("tokens").chunks for x in c]
        label = connect(n[order], [tokens[k] for k in order], percent)
        some = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"a": node[order][some], "b": node[order][label[some]]})

    links = scratch.keep(others.union(heads).groupBy("leader", "at").applyInArrow(link, "a long, b long").distinct())
    large = dealt.where("blocks > 1")
    if not large.limit(1).count():
        return links
    more = _across(large, components(links, scratch), plain, percent, limits, scratch)
    return links if more is None else scratch.keep(links.union(more))


def _across(large: DataFrame, comps: DataFrame, plain: DataFrame, percent: int, limits: Limits, scratch: Scratch) -> DataFrame | None:
    """Links (a, b) between blocks of families that fall into several components, or None.

    The nodes outside a family's largest component are compared with all of its blocks; a
    family of copies of one text has hardly any left by now.
    """
    labelled = scratch.keep(large.join(comps, "node", "left").select("leader", "node", "blocks", "at", F.coalesce("component", "node").alias("component")))
    sizes = labelled.groupBy("leader", "component").agg(F.count("*").alias("c"))
    mains = sizes.groupBy("leader").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.sum("c").alias("m"), F.count("*").alias("found")).where("found > 1")
    odd = scratch.keep(lookup(labelled, scratch.keep(mains), "leader", "m", F.col("node")).where("main is not null").withColumn("odd", F.col("component") != F.col("main")))
    guests = scratch.keep(odd.where("odd").groupBy("leader").agg(F.ceil(F.count("*") / limits.block).cast("long").alias("guests"), F.count("*").alias("m")))
    if not guests.limit(1).count():
        return None
    placed = lookup(odd.drop("m", "main", "found"), guests, "leader", "m", F.col("node"))
    every = F.sequence(F.lit(0).cast("long"), F.col("guests") - 1)
    base = placed.where("not odd or guests > 1").join(plain, "node").select("leader", "at", F.explode(every).alias("guest"), "node", "n", "tokens", "component", F.lit(False).alias("odd"))
    come = placed.where("odd").join(plain, "node").select(
        "leader", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("at"), F.pmod(F.xxhash64("node"), "guests").alias("guest"), "node", "n", "tokens", "component", F.lit(True).alias("odd"),
    )

    def link(key: tuple, table: pa.Table) -> pa.Table:
        node, n, comp, odd = (table.column(c).to_numpy(zero_copy_only=False) for c in ("node", "n", "component", "odd"))
        tokens = [np.frombuffer(x.as_buffer(), np.uint64) for c in table.column("tokens").chunks for x in c]
        starts = np.r_[0, np.cumsum([len(t) for t in tokens])[:-1]]
        values, at = np.unique(np.concatenate(tokens), return_inverse=True)
        marked, a, b = np.zeros(len(values), bool), [], []
        for x in np.flatnonzero(odd):
            own = at[starts[x] : starts[x] + len(tokens[x])]
            marked[own] = True
            common = np.add.reduceat(marked[at].astype(np.int64), starts)
            marked[own] = False
            hit = np.flatnonzero((100 * common >= percent * (n[x] + n - common)) & (comp != comp[x]))
            # one link to each of the other components will do
            for y in hit[np.unique(comp[hit], return_index=True)[1]]:
                a.append(node[x])
                b.append(node[y])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return scratch.keep(base.union(come).groupBy("leader", "at", "guest").applyInArrow(link, "a long, b long").distinct())
