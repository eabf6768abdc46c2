"""Quantiles of errors by counts in logarithmic buckets: sketches that merge by adding, the same in batch and stream."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Relative accuracy of a quantile, and the value below which all are one.
ACCURACY, LEAST = 0.01, 1e-12


def growth(accuracy: float = ACCURACY) -> float:
    """How much larger a bucket's upper end is than the one before it."""
    return (1 + accuracy) / (1 - accuracy)


def bucket_counts(values: DataFrame, keys: list[str], value: str = "error", accuracy: float = ACCURACY) -> DataFrame:
    """``bucket``, ``n`` of each key: how many values lie in (growth ** (bucket - 1), growth ** bucket].

    Values up to ``LEAST``, zeros among them, share the bucket that holds it; nulls and values that are not finite are left out. A key has at most
    one row for each bucket, some 36,000 over all doubles at the usual accuracy. A plain aggregation, so it also runs on a stream.
    """
    bucket = F.ceil(F.ln(F.greatest(F.col(value), F.lit(LEAST))) / math.log(growth(accuracy))).cast("int")
    finite = F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return values.where(finite).groupBy(*keys, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merged_counts(*parts: DataFrame) -> DataFrame:
    """The buckets of several parts together."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy(*[c for c in out.columns if c != "n"]).agg(F.sum("n").alias("n"))


def bucket_quantile(counts: DataFrame, keys: list[str], share: float, accuracy: float = ACCURACY) -> DataFrame:
    """``threshold`` of each key: the upper end of the bucket of the value at rank ceil(share * n).

    At least ``share`` of the values are no larger, and the true quantile is at most a factor ``growth`` below. A key without values has no row.
    """
    if not 0 < share <= 1:
        raise ValueError(f"a share of {share} is not in (0, 1]")
    by = Window.partitionBy(*keys or [F.lit(0)])
    upto = F.sum("n").over(by.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumn("upto", upto).withColumn("rank", F.ceil(F.sum("n").over(by) * F.lit(float(share))))
    first = ranked.where("upto >= rank").groupBy(*keys).agg(F.min("bucket").alias("bucket")).where("bucket is not null")
    return first.select(*keys, F.pow(F.lit(growth(accuracy)), F.col("bucket")).alias("threshold"))


def benign_threshold(scored: DataFrame, keys: list[str], share: float = 0.99, accuracy: float = ACCURACY) -> DataFrame:
    """``threshold`` of each key from the errors of its benign rows (``truth`` = 0)."""
    return bucket_quantile(bucket_counts(scored.where("truth = 0"), keys, "error", accuracy), keys, share, accuracy)
