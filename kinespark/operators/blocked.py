"""Ordered operations that don't put a whole channel into one task.

A channel of billions of samples is cut into blocks of ``block`` positions. What a window needs from
outside its block is either a halo (the last k rows of the block before) or one carried row per block (a
sum, a last value), a table smaller by the block size. All of it is declarative: hash partitions by
(keys, block), partial aggregation, and small joins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16


def _block(idx: str, block: int) -> Column:
    return F.floor(F.col(idx) / block).cast("long")


def dense_index(df: DataFrame, keys: list[str], order: str, out: str = "idx", block: int = BLOCK) -> DataFrame:
    """Positions 0, 1, ... within ``keys`` by the unique integer column ``order``."""
    cut = df.withColumn("__b", _block(order, block))
    sizes = cut.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__s"))
    inside = F.row_number().over(Window.partitionBy(*keys, "__b").orderBy(order)) - 1
    return cut.withColumn("__i", inside).join(starts, [*keys, "__b"]).withColumn(out, (F.col("__s") + F.col("__i")).cast("long")).drop("__b", "__i", "__s")


def running_sum(df: DataFrame, keys: list[str], idx: str, value: Column, out: str, block: int = BLOCK) -> DataFrame:
    """Sum of ``value`` over all rows up to and including each; ``idx`` is the position within ``keys``."""
    cut = df.withColumn("__rs_v", value).withColumn("__rs_b", _block(idx, block))
    sums = cut.groupBy(*keys, "__rs_b").agg(F.sum("__rs_v").alias("__rs_t"))
    before = Window.partitionBy(*keys).orderBy("__rs_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, "__rs_b", F.coalesce(F.sum("__rs_t").over(before), F.lit(0.0)).alias("__rs_s"))
    inside = Window.partitionBy(*keys, "__rs_b").orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
    return cut.withColumn("__rs_r", F.sum("__rs_v").over(inside)).join(starts, [*keys, "__rs_b"]).withColumn(out, F.col("__rs_s") + F.col("__rs_r")).drop("__rs_v", "__rs_b", "__rs_s", "__rs_r")


def greatest_before(df: DataFrame, keys: list[str], idx: str, value: str, out: str, block: int = BLOCK) -> DataFrame:
    """The greatest ``value`` of all rows before each; NULL at the first."""
    cut = df.withColumn("__gb_b", _block(idx, block))
    tops = cut.groupBy(*keys, "__gb_b").agg(F.max(value).alias("__gb_t"))
    before = Window.partitionBy(*keys).orderBy("__gb_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = tops.select(*keys, "__gb_b", F.max("__gb_t").over(before).alias("__gb_s"))
    inside = Window.partitionBy(*keys, "__gb_b").orderBy(idx).rowsBetween(Window.unboundedPreceding, -1)
    return cut.withColumn("__gb_r", F.max(value).over(inside)).join(starts, [*keys, "__gb_b"]).withColumn(out, F.greatest("__gb_s", "__gb_r")).drop("__gb_b", "__gb_s", "__gb_r")


def windowed(df: DataFrame, keys: list[str], idx: str, before: int, after: int, columns: Callable[[Window], dict[str, Column]], block: int = BLOCK) -> DataFrame:
    """``df`` with the columns that ``columns(window)`` makes over an ordered window of its rows; none of them may
    look further than ``before`` rows back or ``after`` ahead. Rows near an edge also go to the neighbour block."""
    block = max(block, 4 * (before + after), 1)
    at = F.col(idx)
    home = _block(idx, block)
    targets = [home]
    if before:
        targets.append(F.when(F.floor((at + before) / block).cast("long") != home, home + 1))
    if after:
        targets.append(F.when(F.floor((at - after) / block).cast("long") != home, home - 1))
    cut = df.withColumn("__home", home).withColumn("__b", F.explode(F.array_compact(F.array(*targets))))
    w = Window.partitionBy(*keys, "__b").orderBy(idx)
    return cut.select("*", *[c.alias(n) for n, c in columns(w).items()]).where("__home = __b").drop("__home", "__b")


def previous(df: DataFrame, keys: list[str], idx: str, columns: dict[str, Column], block: int = BLOCK) -> DataFrame:
    """``df`` with ``columns``, each the expression's value in the row before by ``idx``, however far that is; NULL in the
    first row. (``windowed`` looks back by positions, so it needs them without gaps.)"""
    cut = df.withColumn("__pv_b", _block(idx, block)).withColumn("__pv", F.struct(*[c.alias(n) for n, c in columns.items()]))
    ends = cut.groupBy(*keys, "__pv_b").agg(F.max_by("__pv", idx).alias("__pv_e"))
    carried = ends.select(*keys, "__pv_b", F.lag("__pv_e").over(Window.partitionBy(*keys).orderBy("__pv_b")).alias("__pv_c"))
    inside = F.lag("__pv").over(Window.partitionBy(*keys, "__pv_b").orderBy(idx))
    found = cut.withColumn("__pv_i", inside).join(carried, [*keys, "__pv_b"]).withColumn("__pv", F.coalesce("__pv_i", "__pv_c"))
    return found.select("*", *[F.col(f"__pv.{n}").alias(n) for n in columns]).drop("__pv_b", "__pv", "__pv_i", "__pv_c")


def fill_forward(df: DataFrame, keys: list[str], order: list[str], block_of: Column, columns: list[str]) -> DataFrame:
    """Each of ``columns`` replaced by its last non-null value up to the row. ``block_of`` must be monotone in
    ``order``: rows of a block are sorted together, and each block carries one last value into the next."""
    cut = df.withColumn("__ff_b", block_of)
    w = Window.partitionBy(*keys, "__ff_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rank = F.struct(*order)
    ends = cut.groupBy(*keys, "__ff_b").agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), rank)).alias(f"__e_{c}") for c in columns])
    before = Window.partitionBy(*keys).orderBy("__ff_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, "__ff_b", *[F.last(f"__e_{c}", ignorenulls=True).over(before).alias(f"__c_{c}") for c in columns])
    out = cut.select("*", *[F.last(c, ignorenulls=True).over(w).alias(f"__l_{c}") for c in columns]).join(carried, [*keys, "__ff_b"])
    for c in columns:
        out = out.withColumn(c, F.coalesce(f"__l_{c}", f"__c_{c}"))
    return out.drop("__ff_b", *[f"__l_{c}" for c in columns], *[f"__c_{c}" for c in columns])
