"""Gazetteer files: lists, acronyms by tab, suburbs and postcodes by bar; # begins a comment line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.recognise import Gazetteers


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """(name) of each line that is neither blank nor a comment."""
    return spark.read.text(path).select(F.btrim("value", F.lit(" \t\r")).alias("name")).where("name <> '' and not startswith(name, '#')")


def read_acronyms(spark: SparkSession, path: str) -> DataFrame:
    """(acronym, expansion) of lines acronym TAB expansion; further columns are left out, and so are lines without a tab."""
    parts = F.split("name", "\t")
    return read_list(spark, path).where(F.size(parts) >= 2).select(parts[0].alias("acronym"), parts[1].alias("expansion"))


def _clean(parts):
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def read_suburbs(spark: SparkSession, path: str) -> DataFrame:
    """(suburb, states) of lines name|ST,ST, or a name alone."""
    parts = F.split("name", r"\|", 2)
    states = F.when(F.size(parts) > 1, _clean(F.split(F.try_element_at(parts, F.lit(2)), ","))).otherwise(F.array().cast("array<string>"))
    return read_list(spark, path).select(parts[0].alias("suburb"), states.alias("states"))


def read_postcodes(spark: SparkSession, path: str) -> DataFrame:
    """(code, suburb, state) of lines code|suburb:ST,suburb:ST."""
    parts = F.split("name", r"\|", 2)
    rows = read_list(spark, path).where(F.size(parts) > 1).select(parts[0].alias("code"), F.explode(F.split(parts[1], ",")).alias("e")).where(F.contains("e", F.lit(":")))
    entry = F.split("e", ":", 2)
    return rows.select("code", F.trim(entry[0]).alias("suburb"), F.trim(entry[1]).alias("state")).distinct()


def gazetteers(names: DataFrame | None = None, acronyms: DataFrame | None = None, suburbs: DataFrame | None = None, postcodes: DataFrame | None = None) -> Gazetteers:
    """Tables as what recognisers take; each is read up to the limit of what may be sent to every task, and refused beyond."""
    def rows(df: DataFrame | None) -> list:
        return df.limit(Gazetteers.LIMIT + 1).collect() if df is not None else []

    codes: dict[str, set[tuple[str, str]]] = {}
    for r in rows(postcodes):
        codes.setdefault(r["code"], set()).add((r["suburb"], r["state"]))
    return Gazetteers([r["name"] for r in rows(names)], {r["acronym"]: r["expansion"] for r in rows(acronyms)}, {r["suburb"]: set(r["states"] or []) for r in rows(suburbs)}, codes)
