"""Resharding as a minimum-cost flow: fewest bytes moved from old shards to new capacities."""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW_KEY, Scratch, ranked, row_keyed

#: size classes to an octave of row size; a block is the rows of one old shard and size class
CLASSES_PER_OCTAVE = 2


class Flow:
    """Minimum-cost flow by successive shortest paths with potentials; all costs are 0 or more."""

    def __init__(self) -> None:
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[float] = []
        self.out: dict[int, list[int]] = defaultdict(list)

    def arc(self, a: int, b: int, room: int, cost: float = 0.0) -> int:
        for u, v, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[u].append(len(self.to))
            self.to.append(v)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def sent(self, arc: int) -> int:
        return self.room[arc ^ 1]

    def run(self, source: int, sink: int) -> int:
        height: dict[int, float] = defaultdict(float)
        total = 0
        while True:
            far, by, heap = {source: 0.0}, {}, [(0.0, source)]
            while heap:
                d, u = heapq.heappop(heap)
                if d > far[u]:
                    continue
                for e in self.out[u]:
                    if self.room[e]:
                        v = self.to[e]
                        dv = d + max(0.0, self.cost[e] + height[u] - height[v])
                        if dv < far.get(v, float("inf")):
                            far[v], by[v] = dv, e
                            heapq.heappush(heap, (dv, v))
            if sink not in far:
                return total
            for v in set(self.to) | {source}:
                height[v] += far.get(v, far[sink])
            push, v = float("inf"), sink
            while v != source:
                push = min(push, self.room[by[v]])
                v = self.to[by[v] ^ 1]
            v = sink
            while v != source:
                self.room[by[v]] -= push
                self.room[by[v] ^ 1] += push
                v = self.to[by[v] ^ 1]
            total += push


def plan_transfers(blocks: list[tuple[int, int, int, int]], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(old shard, size class, new shard, first, last + 1): which stretch of each block goes where.

    blocks: (old shard, size class, rows, bytes).  New shards hold rows // shards
    rows each, and rows % shards of them one more.  A row that stays in the shard
    of its own number costs nothing, any other its bytes.  In a block the
    stretches that move come first; rows are ranked by rising size, so the
    smallest ones move.
    """
    total = sum(b[2] for b in blocks)
    low, more = divmod(total, shards)
    source, sink, hub, extra, first_shard, first_block = 0, 1, 2, 3, 4, 4 + shards
    flow = Flow()
    goes, stays, moves = [], {}, {}
    for k, (old, _, rows, size) in enumerate(blocks):
        flow.arc(source, first_block + k, rows)
        if 0 <= old < shards:
            stays[k] = flow.arc(first_block + k, first_shard + old, rows)
        moves[k] = flow.arc(first_block + k, hub, rows, size / rows)
    for j in range(shards):
        goes.append(flow.arc(hub, first_shard + j, total))
        flow.arc(first_shard + j, sink, low)
        flow.arc(first_shard + j, extra, 1)
    flow.arc(extra, sink, more)
    if flow.run(source, sink) != total:
        raise ValueError("the capacities don't hold all rows")
    wanted = [[j, flow.sent(e)] for j, e in enumerate(goes) if flow.sent(e)]
    out = []
    for k, (old, kind, rows, _) in enumerate(blocks):
        at, left = 0, flow.sent(moves[k])
        while left:
            take = min(left, wanted[-1][1])
            out.append((old, kind, wanted[-1][0], at, at + take))
            at, left = at + take, left - take
            wanted[-1][1] -= take
            if not wanted[-1][1]:
                wanted.pop()
        if at < rows:
            out.append((old, kind, old, at, rows))
    return out


def sized(docs: DataFrame, old_shard, id_col: str = "doc_id", text_col: str = "text", keep: list[str] = ()) -> DataFrame:
    """(doc_id, size, text_crc32, old_shard, kind), and columns to keep: size is the text's UTF-8 bytes and 8."""
    size = size_of(text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"), size.alias("size"), text_crc(text_col).alias("text_crc32"), old_shard.cast("int").alias("old_shard"),
        F.floor(F.log2(size) * CLASSES_PER_OCTAVE).cast("int").alias("kind"), *keep,
    )


def size_of(text_col: str):
    return (F.coalesce(F.octet_length(text_col), F.lit(0)) + 8).cast("long")


def text_crc(text_col: str):
    return F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))


def reshard(docs: DataFrame, old_shard, shards: int, scratch: Scratch, keep: list[str] = ()) -> DataFrame:
    """New shard and slot of every row, by the flow that moves the fewest bytes.

    old_shard: expression for the shard that holds a row now (an old shard
    without a number among the new ones empties; null counts as -1).  New shards
    hold equally many rows, at most one apart.  Returns doc_id, size,
    text_crc32, old_shard, shard, slot (0 up to the shard's rows, no gaps), and the columns to keep, which also settle ties.
    Null and empty texts have size 8; rows that repeat are dealt as rows of
    their own; null ids sort first; an empty table gives an empty one; other
    columns aren't read.

    Only the table of blocks comes to the driver: old shards x size classes,
    62 classes at most.  Ranks come from range-dealt stretches, so neither an old
    shard nor a new one is gathered in a task.
    """
    spark: SparkSession = scratch.spark
    rows = scratch.keep(sized(docs, F.coalesce(old_shard, F.lit(-1)), keep=keep))
    blocks = [tuple(r) for r in rows.groupBy("old_shard", "kind").agg(F.count("*"), F.sum("size")).orderBy("old_shard", "kind").collect()]
    moves = plan_transfers(blocks, shards) if blocks else []
    plan = spark.createDataFrame(moves, "_old int, _kind int, shard int, _lo long, _hi long")
    placed = ranked(rows, ["old_shard", "kind"], ["size", "doc_id", "text_crc32", *keep], "_rank", scratch)
    on = (F.col("old_shard") == F.col("_old")) & (F.col("kind") == F.col("_kind")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi"))
    dealt = placed.join(F.broadcast(plan), on).select("doc_id", "size", "text_crc32", "old_shard", "shard", *keep)
    return ranked(dealt, ["shard"], ["doc_id", "text_crc32", *keep], "slot", scratch)


def affected(layout: DataFrame) -> list[int]:
    """Shards, old or new, that a row leaves or comes to."""
    moved = layout.where(~F.col("old_shard").eqNullSafe(F.col("shard")))
    return sorted(r[0] for r in moved.select(F.explode(F.array("old_shard", "shard")).alias("s")).distinct().collect())


def rewrite(docs: DataFrame, old_shard, layout: DataFrame, touched: list[int], folder: str, files: int = 1) -> None:
    """Write the new state of the touched shards under folder/shard=N, rows in the order of their slots, `files` files to a shard.

    docs: rows with doc_id, text, the columns of ROW_KEY and what else is to be written, of the touched shards at least; layout: as `reshard` gives
    it, with ROW_KEY.  Where a row goes shows in itself: what a block gives to a shard is a range of its rows' order, and so is a
    file's part of a shard.  The bounds of these ranges, a row for each transfer and each file, are all that is sent to the tasks, and texts are
    exchanged once.  A shard that is left without rows has no folder.
    """
    by_size, by_id = ["size", "doc_id", "text_crc32", *ROW_KEY], ["doc_id", "text_crc32", *ROW_KEY]
    kind = F.floor(F.log2("size") * CLASSES_PER_OCTAVE).cast("int")
    some = layout.where(F.col("shard").isin(touched)).withColumn("kind", kind)
    longest = (some.agg(F.max("slot")).first()[0] or 0) + 1
    given = some.groupBy(F.col("old_shard").alias("_old"), F.col("kind").alias("_kind"), "shard").agg(F.min(F.struct(*by_size)).alias("_from"), F.max(F.struct(*by_size)).alias("_to"))
    parts = some.groupBy(F.col("shard").alias("_shard"), F.floor(F.col("slot") * files / longest).cast("int").alias("_file")).agg(
        F.min(F.struct(*by_id)).alias("_first"), F.max(F.struct(*by_id)).alias("_last"), F.min("slot").alias("_slot")
    )
    own = docs.withColumn("size", size_of("text")).withColumn("text_crc32", text_crc("text")).withColumn("old_shard", F.coalesce(old_shard, F.lit(-1)).cast("int"))
    dealt = own.join(F.broadcast(given), (F.col("old_shard") == F.col("_old")) & (kind == F.col("_kind")) & F.struct(*by_size).between(F.col("_from"), F.col("_to")))
    placed = dealt.join(F.broadcast(parts), (F.col("shard") == F.col("_shard")) & F.struct(*by_id).between(F.col("_first"), F.col("_last")))
    number = F.element_at(F.create_map(*[F.lit(x) for p in enumerate(touched) for x in reversed(p)]), F.col("shard")) * files + F.col("_file") if touched else F.lit(0)
    more = [c for c in docs.columns if c not in ROW_KEY and not c.startswith("_")]
    rows = placed.select(*more, "text_crc32", *ROW_KEY, "shard", "_slot", number.alias("_number")).repartitionById(max(1, len(touched) * files), "_number").sortWithinPartitions(*by_id)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows.select(*more, "shard", (F.col("_slot") + place).alias("slot")).write.mode("overwrite").option("compression", "zstd").partitionBy("shard").parquet(folder)


def reshard_folder(spark: SparkSession, folder: str, shards: int, scratch: Scratch, files: int = 1) -> list[int]:
    """Reshard a folder of shard=N folders (doc_id, text, slot, and whatever else) in place; returns the shards that were rewritten.

    Only the files of affected shards are read for their texts' rows; those of others stay as they are.  What is new is written beside
    the folder first and moved into it when it is complete, old shards without rows are removed; a run that dies before that has changed nothing.
    """
    old = row_keyed(spark.read.parquet(folder))
    layout = scratch.keep(reshard(old, F.col("shard"), shards, scratch, ROW_KEY))
    touched = affected(layout)
    if not touched:
        return []
    new = f"{folder.rstrip('/')}.new"
    rewrite(old.where(F.col("shard").isin(touched)).withColumnRenamed("shard", "_was").drop("slot"), F.col("_was"), layout, touched, new, files)
    filled = {r[0] for r in layout.where(F.col("shard").isin(touched)).select("shard").distinct().collect()}
    jvm = spark._jvm
    fs = jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for s in touched:
        own = jvm.org.apache.hadoop.fs.Path(f"{folder}/shard={s}")
        fs.delete(own, True)
        if s in filled and not fs.rename(jvm.org.apache.hadoop.fs.Path(f"{new}/shard={s}"), own):
            raise OSError(f"can't move the new shard {s} into {folder}")
    fs.delete(jvm.org.apache.hadoop.fs.Path(new), True)
    return touched
