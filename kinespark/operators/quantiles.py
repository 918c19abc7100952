"""Exact order statistics of long channels without sorting them.

Doubles are cut into bins of equal order: their power of two, and 256 steps within it. One aggregation counts the bins (about
a million at most for each key, whatever its length); the ranks that are wanted fall into a few of them, and only the
values of those bins are counted one by one, in a second aggregation. Nothing holds a channel in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import finite, nan


def _bin(value: Column) -> Column:
    """Bins in the order of their values (the logarithm is monotone, rounding included); those of negative numbers count down."""
    size = F.abs(value)
    e = F.greatest(F.least(F.floor(F.log2(F.when(size > 0, size))), F.lit(1023)), F.lit(-1022))
    fraction = F.floor(F.least(F.greatest(size / F.pow(F.lit(2.0), e.cast("double")) - 1.0, F.lit(0.0)), F.lit(0.999)) * 256)
    at = F.when(size > 0, (e + 1023) * 256 + fraction + 1).otherwise(0).cast("long")
    return F.when(value < 0, -at).otherwise(at)


def order_statistics(df: DataFrame, keys: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """(keys, one column for each of ``ranks``): the value of that rank, counted from 1, among a key's finite values.
    ``ranks``: expressions over n, the number of values."""
    v = df.where(finite(F.col(value))).select(*keys, F.col(value).cast("double").alias("__v")).withColumn("__bin", _bin(F.col("__v")))
    counts = v.groupBy(*keys, "__bin").agg(F.count(F.lit(1)).alias("__c"))
    w = Window.partitionBy(*keys).orderBy("__bin")
    edges = counts.withColumn("__before", F.sum("__c").over(w) - F.col("__c")).withColumn("n", F.sum("__c").over(Window.partitionBy(*keys)))
    names = list(ranks)
    wanted = F.array(*[F.struct(F.lit(k).alias("name"), r.cast("long").alias("rank")) for k, r in ranks.items()])
    hit = edges.select(*keys, "__bin", "__before", "__c", F.explode(wanted).alias("w")).where((F.col("w.rank") > F.col("__before")) & (F.col("w.rank") <= F.col("__before") + F.col("__c")))
    bins = hit.select(*keys, "__bin", "__before").distinct()
    exact = v.join(bins, [*keys, "__bin"]).groupBy(*keys, "__bin", "__before", "__v").agg(F.count(F.lit(1)).alias("__c"))
    inside = Window.partitionBy(*keys, "__bin").orderBy("__v")
    placed = exact.withColumn("__to", F.col("__before") + F.sum("__c").over(inside))
    picked = placed.join(hit.select(*keys, "__bin", "w.name", "w.rank"), [*keys, "__bin"]).where((F.col("rank") <= F.col("__to")) & (F.col("rank") > F.col("__to") - F.col("__c")))
    return picked.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == k, F.col("__v"))).alias(k) for k in names])


def percentiles(df: DataFrame, keys: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """(keys, one column for each of ``wanted``: name to q in 0..100): exact percentiles, linear between order statistics;
    keys without a finite value have NaN."""
    at = lambda q: (F.col("n") - 1) * (q / 100.0)
    ranks = {f"{k}__{side}": f(at(q)) + 1 for k, q in wanted.items() for side, f in (("a", F.floor), ("b", F.ceil))}
    found = order_statistics(df, keys, value, ranks)
    sizes = df.groupBy(*keys).agg(F.count(F.when(finite(F.col(value)), 1)).alias("n"))
    part = lambda q: at(q) - F.floor(at(q))
    between = lambda k, q: F.col(f"{k}__a") * (1 - part(q)) + F.col(f"{k}__b") * part(q)
    return sizes.join(found, keys, "left").select(*keys, *[F.coalesce(between(k, q), nan()).alias(k) for k, q in wanted.items()])
