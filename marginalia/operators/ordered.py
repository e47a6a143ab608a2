"""Windows over groups that may be too large for one task.

``split_hot`` finds the few groups above a row limit with one map-side-combined count.  Ordinary groups keep an
ordinary ``Window``.  A large group is range-partitioned by its own order into balanced chunks that are written to
the shared folder; windows run per chunk, and one summary row per chunk carries the running value across.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.session import durable

HOT_ROWS = 1_000_000
BROADCAST_ROWS = 100_000
CHUNK = "_chunk"


def same_keys(left: DataFrame, right: DataFrame, keys: list[str], prefix: str) -> Column:
    """Null-safe equality of ``keys`` with the columns of ``right`` renamed by ``prefix``."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[prefix + k]) for k in keys])


def hot_groups(df: DataFrame, keys: list[str], limit: int = HOT_ROWS) -> tuple[DataFrame | None, int]:
    """(keys of the groups of ``df`` above ``limit``, renamed by ``_hot_``, or None; how many rows these have)."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit)
    groups, rows = counts.agg(F.count(F.lit(1)), F.sum("_n")).first()
    if not groups:
        return None, 0
    hot_keys = durable(counts.select(*[F.col(k).alias(f"_hot_{k}") for k in keys]))
    return F.broadcast(hot_keys) if groups <= BROADCAST_ROWS else hot_keys, rows


def split_at(df: DataFrame, keys: list[str], hot_keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of other groups, rows of those that ``hot_groups`` found)."""
    match = same_keys(df, hot_keys, keys, "_hot_")
    return df.join(hot_keys, match, "left_anti"), df.join(hot_keys, match, "left_semi")


def split_hot(
    df: DataFrame, keys: list[str], limit: int = HOT_ROWS, sizes: DataFrame | None = None
) -> tuple[DataFrame, DataFrame | None, int]:
    """(ordinary rows, rows of groups above ``limit`` or None, how many such rows).

    ``sizes`` is counted instead of ``df``: a cheaper table that has at least the groups' rows.
    """
    hot_keys, rows = hot_groups(df if sizes is None else sizes, keys, limit)
    return (df, None, 0) if hot_keys is None else (*split_at(df, keys, hot_keys), rows)


class OrderedGroups:
    """Running columns over ``keys`` in a total ``order``; ``df`` holds the result so far."""

    def __init__(
        self, df: DataFrame, keys: list[str], order: list[str], limit: int = HOT_ROWS, sizes: DataFrame | None = None
    ):
        self.keys, self.order = keys, order
        cold, hot, rows = split_hot(df, keys, limit, sizes)
        self.hot = hot is not None
        if self.hot:
            self.chunks = max(2, math.ceil(2 * rows / limit))
            chunked = hot.repartitionByRange(self.chunks, *keys, *order).withColumn(CHUNK, F.spark_partition_id())
            self.df = cold.withColumn(CHUNK, F.lit(-1)).unionByName(durable(chunked))
        else:
            self.df = cold
        self.partition = keys + ([CHUNK] if self.hot else [])

    def window(self):
        return Window.partitionBy(*self.partition).orderBy(*self.order)

    def row_number(self, name: str) -> OrderedGroups:
        return self.running_sum(name, F.lit(1))

    def running_sum(self, name: str, value: Column) -> OrderedGroups:
        """Sum of ``value`` up to and including the row; null as long as all values are."""
        return self._running(name, value, F.sum, lambda here, carry: F.coalesce(here + carry, here, carry))

    def running_max(self, name: str, value: Column) -> OrderedGroups:
        """Largest ``value`` up to and including the row."""
        return self._running(name, value, F.max, F.greatest)

    def _running(self, name: str, value: Column, total, combine) -> OrderedGroups:
        frame = self.window().rowsBetween(Window.unboundedPreceding, 0)
        if not self.hot:
            self.df = self.df.withColumn(name, total(value).over(frame))
            return self
        self.df = self.df.withColumn("_value", value)
        totals = self._chunks().agg(total("_value").alias("_carry"))
        before = Window.partitionBy(*self.keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
        carried = self._carry(totals.withColumn("_carry", total("_carry").over(before)))
        self.df = carried.withColumn(name, combine(total("_value").over(frame), F.col("_carry"))).drop("_value", "_carry")
        return self

    def previous(self, name: str, value: Column) -> OrderedGroups:
        """``value`` of the row before."""
        if not self.hot:
            self.df = self.df.withColumn(name, F.lag(value).over(self.window()))
            return self
        self.df = self.df.withColumn("_value", value)
        last = self._chunks().agg(F.max_by("_value", F.struct(*self.order)).alias("_carry"))
        across = Window.partitionBy(*self.keys).orderBy(CHUNK)
        carried = self._carry(last.withColumn("_carry", F.lag("_carry").over(across)))
        first = F.row_number().over(self.window()) == 1
        self.df = carried.withColumn(
            name, F.when(first, F.col("_carry")).otherwise(F.lag("_value").over(self.window()))
        ).drop("_value", "_carry")
        return self

    def result(self) -> DataFrame:
        return self.df.drop(CHUNK)

    def _chunks(self):
        return self.df.filter(F.col(CHUNK) >= 0).groupBy(*self.keys, CHUNK)

    def _carry(self, summary: DataFrame) -> DataFrame:
        """Attach ``_carry``.  A range chunk continues at most one group, so the summary has at most one row per chunk."""
        keys = self.keys + [CHUNK]
        side = summary.filter(F.col("_carry").isNotNull()).select(*[F.col(k).alias(f"_c_{k}") for k in keys], "_carry")
        if self.chunks <= BROADCAST_ROWS:
            side = F.broadcast(side)
        return self.df.join(side, same_keys(self.df, side, keys, "_c_"), "left").drop(*[f"_c_{k}" for k in keys])


def with_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Adds the place of each row in ``order``, 1-based; rows alike in it are in no certain order among each other.

    The rows are cut into ranges of ``order``, ranked within their range, and moved on by the rows of the ranges before,
    of which the driver sees one number each.
    """
    ranged = durable(df.repartitionByRange(*order).withColumn(CHUNK, F.spark_partition_id()))
    before = Window.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy(CHUNK).agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    placed = ranged.join(F.broadcast(sizes.select(CHUNK, "_before")), CHUNK)
    place = F.row_number().over(Window.partitionBy(CHUNK).orderBy(*order)) + F.col("_before")
    return placed.withColumn(name, place.cast("bigint")).drop(CHUNK, "_before")


def centred_mean(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    value: Column,
    name: str,
    half: int,
    limit: int = HOT_ROWS,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Mean of ``value`` over the rows at most ``half`` before and after, cut at the group's ends.

    A large group is cut into blocks of rows; each block also gets the ``half`` rows beside it.
    """
    cold, hot, _ = split_hot(df, keys, limit, sizes)
    mean = F.avg(value)
    result = cold.withColumn(name, mean.over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(-half, half)))
    if hot is None:
        return result
    size = max(limit // 2, 2 * half + 1)
    placed = OrderedGroups(hot, keys, order, limit).row_number("_row").result().withColumn("_row", F.col("_row") - 1)
    block = F.floor(F.col("_row") / size)
    reach = F.array_distinct(F.array(F.floor((F.col("_row") - half) / size), block, F.floor((F.col("_row") + half) / size)))
    spread = placed.withColumn("_home", block).withColumn("_block", F.explode(reach))
    near = Window.partitionBy(*keys, "_block").orderBy("_row").rowsBetween(-half, half)
    smoothed = spread.withColumn(name, mean.over(near)).filter(F.col("_block") == F.col("_home"))
    return result.unionByName(smoothed.drop("_row", "_home", "_block"))
