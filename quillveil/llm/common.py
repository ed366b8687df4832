"""What the operators of this subpackage share: scratch tables, skew-safe lookups, components."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import ranks
from ..ship import ship

#: rows of a hot-key table, and so the bound of what is broadcast for it
HOT_KEYS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir.  Only a local master, whose workers share the machine, may leave it unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='quillveil-')}"
        spark.conf.set("spark.checkpoint.dir", at)
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


ROW_KEY = ["_key_file", "_key_row"]


def row_keyed(docs: DataFrame) -> DataFrame:
    """docs with two numbers that tell every row from all others (ROW_KEY), whatever its columns hold.

    Rows of parquet files are known by the file's name, hashed, and their place in it, so
    the numbers are the same however the scan is cut; rows of other tables by Spark's own numbering, which
    holds as long as the plan below gives the same partitions again.
    """
    try:
        return docs.select("*", F.xxhash64("_metadata.file_path").alias(ROW_KEY[0]), F.col("_metadata.row_index").alias(ROW_KEY[1]))
    except AnalysisException:
        return docs.select("*", F.lit(0).cast("long").alias(ROW_KEY[0]), F.monotonically_increasing_id().alias(ROW_KEY[1]))


class Scratch:
    """Tables written to the shared folder, which cut the lineage and survive lost executors.

    A table that no later plan reads is dropped as soon as it is used up; those
    that a returned DataFrame reads stay until the shared folder is cleaned.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        self.paths: dict[int, str] = {}

    def path(self) -> str:
        self.count += 1
        return f"{self.root}/{self.count}"

    def keep(self, df: DataFrame, partition_by: str | None = None) -> DataFrame:
        at = self.path()
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        self.paths[id(out)] = at
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            at = self.paths.pop(id(t), None)
            if at:
                self.remove(at)
        self.release()

    def remove(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def release(self) -> None:
        """Let Spark remove the shuffle files of plans that nothing refers to any more."""
        gc.collect()
        self.spark._jvm.System.gc()


def lookup(left: DataFrame, right: DataFrame, key: str, weight: str, spread: Column, hot_keys: int = HOT_KEYS) -> DataFrame:
    """left LEFT JOIN right on key, whatever share of left has one key.

    right has a row for each key and says in `weight` how many rows of left
    have it.  The `hot_keys` heaviest keys go as a broadcast table, which is
    bounded by that count; each other key then has at most 1/hot_keys of left's
    rows, and is met by sort-merge.  Rows answered by the broadcast are spread
    over the exchange by `spread` instead of by their key.  Null keys find nothing.
    """
    cols = [c for c in right.columns if c != key]
    hot = (
        right.where(F.col(weight) > 1)
        .orderBy(F.desc(weight), key)
        .limit(hot_keys)
        .select(F.col(key).alias("_hot_key"), F.lit(True).alias("_hot"), F.struct(*cols).alias("_hot_row"))
    )
    met = left.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left").withColumn(
        "_salt", F.when(F.col("_hot") | F.col(key).isNull(), F.xxhash64(spread)).otherwise(F.lit(0).cast("long"))
    )
    cold = right.select(F.col(key).alias("_cold_key"), F.lit(0).cast("long").alias("_cold_salt"), F.struct(*cols).alias("_cold_row"))
    joined = met.join(
        cold,
        (F.col(key) == F.col("_cold_key")) & (F.col("_salt") == F.col("_cold_salt")) & F.col("_hot").isNull(),
        "left",
    )
    row = F.coalesce("_hot_row", "_cold_row")
    return joined.select(*left.columns, *[row[c].alias(c) for c in cols])


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component): the smallest node reachable from each node of undirected edges (a, b).

    Every node hooks to its smallest neighbour, pointers are doubled until they
    rest on roots, and the edges are rewritten between roots; that repeats until
    no edge is left.  All steps are joins and partial aggregates of shrinking
    tables; hot nodes are met by `lookup`.
    """
    spark = scratch.spark
    live = scratch.keep(edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    done: list[DataFrame] = []
    while live.limit(1).count():
        both = live.union(live.select("b", "a"))
        hooks = scratch.keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("up"), F.count("*").alias("n")))
        while True:
            # jump: the parent's parent
            ups = hooks.groupBy("up").agg(F.count("*").alias("m")).join(hooks.select(F.col("node").alias("up"), F.col("up").alias("upper")), "up")
            jumped = scratch.keep(lookup(hooks, ups, "up", "m", F.col("node")).select("node", F.coalesce("upper", "up").alias("new_up"), "n", (F.coalesce("upper", "up") != F.col("up")).alias("moved")))
            moved = jumped.where("moved").limit(1).count()
            scratch.drop(hooks)
            hooks = jumped.select("node", F.col("new_up").alias("up"), "n")
            if not moved:
                break
            kept = scratch.keep(hooks)
            scratch.drop(jumped)
            hooks = kept
        ends = hooks.select("node", "up", "n")
        one = lookup(live.withColumnRenamed("a", "node"), ends, "node", "n", F.col("b")).select(F.col("up").alias("a"), F.col("b").alias("node"))
        two = lookup(one, ends, "node", "n", F.col("a")).select("a", F.col("up").alias("b"))
        live = scratch.keep(two.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        done.append(ends.select("node", "up"))
    if not done:
        kind = edges.schema["a"].dataType
        return spark.createDataFrame([], T.StructType([T.StructField("node", kind), T.StructField("component", kind)]))
    out = done[0].select("node", F.col("up").alias("component"))
    for later in done[1:]:
        sizes = out.groupBy("component").agg(F.count("*").alias("m"))
        roots = sizes.join(later.select(F.col("node").alias("component"), F.col("up")), "component")
        out = scratch.keep(lookup(out, roots, "component", "m", F.col("node")).select("node", F.coalesce("up", "component").alias("component")))
    return out


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "8m") -> None:
    """Ready for Python workers: the package shipped, and Arrow batches of at most `rows` rows and about `size` bytes, so that batches of very long texts fit a worker.

    The settings stay for the session, as the plans that need them run after this returns.
    """
    ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def ordered(df: DataFrame, groups: list[str], order: list[str], scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Rows in the order of (groups, order), and where each group begins in each stretch of them.

    Rows are dealt by range over the whole key, so no group is gathered in one
    task.  Adds `_part` (the stretch) and `_row` (place in the stretch); the
    second table has a row per group and stretch: `_first` and `_n`, the first
    place and the rows there.
    """
    rows = scratch.keep(ranks.dealt(df, order, groups))
    return rows, rows.groupBy("_part", *groups).agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))


def ranked(df: DataFrame, groups: list[str], order: list[str], name: str, scratch: Scratch) -> DataFrame:
    """df with each row's place in its group, from 0 and without gaps, in a column `name`."""
    return ranks.ranked(df, order, name, groups, cut=scratch.keep)


def heaviest(df: DataFrame, weight: str, limit: int) -> DataFrame:
    """The rows of df with the largest whole weights, `limit` at most, without any order.

    A histogram of some hundred bins tells from which weight on there are no more
    than `limit` rows, so no task hands rows to the driver that aren't wanted.
    """
    exponent = F.floor(F.log2(F.greatest(F.col(weight), F.lit(1))))
    low = F.col(weight) / F.pow(F.lit(2.0), exponent)
    bins = df.select((exponent * 16 + F.floor((low - 1) * 16)).cast("int").alias("bin"), F.col(weight).alias("w")).groupBy("bin").agg(F.count("*").alias("n"), F.min("w").alias("least")).collect()
    total, least = 0, None
    for b in sorted(bins, key=lambda r: -r["bin"]):
        total += b["n"]
        if total > limit:
            break
        least = b["least"]
    return df.where(F.col(weight) >= least) if least is not None else df.limit(0)
