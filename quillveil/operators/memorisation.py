"""Which generated texts a model seems to know by heart: likelihoods against each other and against a compressor."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from .ranks import largest


@pandas_udf(LongType())
def compressed_size(texts: pd.Series) -> pd.Series:
    """Bytes of each text's UTF-8 under zlib; null is empty."""
    return texts.fillna("").map(lambda t: len(zlib.compress(t.encode("utf-8"))))


def perplexity(loss: Column) -> Column:
    """exp of a mean token loss."""
    return F.exp(loss)


def scored(samples: DataFrame) -> DataFrame:
    """samples (text, xl, small, lower: perplexities by the large model, the small one, and the large one of the lower-cased text) with four metrics; the ratios are null where xl is 1."""
    log_xl = F.log("xl")
    return samples.withColumn("zlib", compressed_size("text")).select(
        "*", (-log_xl).alias("by_likelihood"), F.try_divide(F.log("small"), log_xl).alias("by_small_model"), F.try_divide(F.log("lower"), log_xl).alias("by_lower_case"), F.try_divide("zlib", log_xl).alias("by_zlib")
    )


METRICS = ["by_likelihood", "by_small_model", "by_lower_case", "by_zlib"]


def best(samples: DataFrame, n: int = 10, ties: str = "text") -> DataFrame:
    """(metric, score, ...) of the n best samples by each metric."""
    every = scored(samples)
    parts = [largest(every.where(F.col(m).isNotNull() & ~F.isnan(m)), m, n, [ties]).select(F.lit(m).alias("metric"), F.col(m).alias("score"), *samples.columns) for m in METRICS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
