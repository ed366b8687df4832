"""Places in an order without gathering rows: rows are dealt by range, each stretch counts its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dealt(df: DataFrame, order: list[Column | str], groups: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """df dealt and sorted by (groups, order), with `_part`, the stretch, and `_row`, the place in it."""
    groups = groups or []
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(n, *groups, *order).sortWithinPartitions(*groups, *order)
    return rows.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_row"))


def ranked(df: DataFrame, order: list[Column | str], name: str = "place", groups: list[str] | None = None, cut=None) -> DataFrame:
    """df with each row's place in its group, from 0 and without gaps, in a column `name`.

    What is put in sequence by one task is a row for each stretch and group.  cut: what to do with the dealt rows so that
    they are worked out once (write them, say); without it the plan deals twice, and the order has to be total for both to agree.
    """
    groups = groups or []
    rows = dealt(df, order, groups)
    rows = cut(rows) if cut else rows
    sizes = rows.groupBy("_part", *groups).agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("_part").alias("_p"), *[F.col(g).alias(f"_g_{g}") for g in groups], "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    on = F.col("_part") == F.col("_p")
    for g in groups:
        on = on & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    return rows.join(F.broadcast(starts) if not groups else starts, on).select(*df.columns, (F.col("_row") - F.col("_first") + F.col("_before")).cast("long").alias(name))


def batches(df: DataFrame, order: list[Column | str], size: int, name: str = "batch") -> DataFrame:
    """Rows in batches of `size` in their order, numbered from 0."""
    if size < 1:
        raise ValueError("a batch holds one row at least")
    return ranked(df, order, "_place").select(*df.columns, F.floor(F.col("_place") / size).cast("long").alias(name))


def first_rows(df: DataFrame, order: list[Column | str], n: int) -> DataFrame:
    """The first n rows of an order; 0 or less: all of them."""
    return df.orderBy(*order).limit(n) if n > 0 else df


def largest(df: DataFrame, metric: Column | str, n: int, ties: list[str]) -> DataFrame:
    """The n rows of the largest metric; of equal ones those first by `ties`."""
    return df.orderBy(F.col(metric).desc() if isinstance(metric, str) else metric.desc(), *ties).limit(n)


def sorted_map(entries: DataFrame, key: str, value: str) -> DataFrame:
    """One row with a map whose entries come by rising key."""
    return entries.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key).alias("key"), F.col(value).alias("value"))))).alias("counts"))


def left_over(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The rows whose key isn't among those done yet."""
    return rows.join(done.select(key).distinct(), key, "left_anti")
