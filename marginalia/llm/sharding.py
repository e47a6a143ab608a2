"""Uniform shuffle into shards of exact size (operator 1).

How many rows each input partition sends to each shard follows a multivariate hypergeometric law, as if all rows had
been permuted at once.  The matrix of those counts is drawn first, from the partition sizes alone; each partition
then permutes its own rows and cuts them by its line of the matrix, the rows are exchanged, and each shard is
permuted again.  Only partition sizes (one number per partition) pass through the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import stored

NUMPY_LIMIT = 10**9
SMALL_TABLE = 100_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` rows taken from ``good + bad`` are good."""
    if good + bad < NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, draws))
    low, high = max(0, draws - bad), min(good, draws)
    total = good + bad
    mean = draws * good / total
    spread = math.sqrt(max(mean * (bad / total) * (total - draws) / max(total - 1, 1), 1.0))
    low, high = max(low, int(mean - 40 * spread) - 40), min(high, int(mean + 40 * spread) + 40)
    x = np.arange(low, high, dtype=np.float64)
    steps = np.log(good - x) + np.log(draws - x) - np.log(x + 1) - np.log(bad - draws + x + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    weights = np.cumsum(np.exp(logs - logs.max()))
    return low + int(np.searchsorted(weights, rng.random() * weights[-1], side="right"))


def communication_matrix(sizes: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows each partition sends to each shard: line sums are ``sizes``, column sums differ by one at most."""
    rng = np.random.default_rng([seed, 1])
    total = sum(sizes)
    open_places = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = np.zeros((len(sizes), shards), dtype=np.int64)
    for line, size in enumerate(sizes):
        rest, left = size, sum(open_places)
        for s in range(shards - 1):
            left -= open_places[s]
            matrix[line, s] = hypergeometric(rng, open_places[s], left, rest) if rest else 0
            rest -= int(matrix[line, s])
        matrix[line, shards - 1] = rest
        open_places = [o - int(c) for o, c in zip(open_places, matrix[line], strict=True)]
    return matrix


def shuffle_into_shards(rows: DataFrame, shards: int, seed: int = 0, block_rows: int = 20_000) -> DataFrame:
    """``rows`` with ``shard`` and ``slot``: a uniform permutation, cut into shards whose counts differ by one at most.

    All columns are carried; input columns named ``shard`` or ``slot`` are replaced.  Nulls and repeated rows are rows
    like any others; an empty input gives an empty result.  Within a shard ``slot`` counts from 0 without gaps.
    ``block_rows`` bounds the rows one task permutes after the exchange.
    """
    spark = rows.sparkSession
    position = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = rows.select(F.struct("*").alias("row")).withColumn("part", F.spark_partition_id()).withColumn("pos", position)
    placed = stored(placed, "sharding-input")
    counted = sorted(placed.groupBy("part").count().collect())
    sizes = {part: (line, n) for line, (part, n) in enumerate(counted)}
    matrix = spark.sparkContext.broadcast(communication_matrix([n for _, n in counted], shards, seed))

    @F.pandas_udf("int")
    def shard_of(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        held, labels = None, None
        for part, pos in columns:
            parts, positions = part.to_numpy(), pos.to_numpy()
            shard = np.empty(len(parts), dtype=np.int32)
            for one in np.unique(parts):
                if one != held:
                    line, size = sizes[int(one)]
                    cut = np.repeat(np.arange(shards, dtype=np.int32), matrix.value[line])
                    held, labels = one, cut[np.random.default_rng([seed, 2, int(one)]).permutation(size)]
                mine = parts == one
                shard[mine] = labels[positions[mine]]
            yield pd.Series(shard)

    total = sum(n for _, n in counted)
    blocks = max(1, math.ceil(total / shards / block_rows))
    key = F.xxhash64(F.lit(seed), F.col("part"), F.col("pos"))
    block = F.shiftright(F.shiftrightunsigned("key", 33) * F.lit(blocks), 31).cast("int")
    sent = placed.withColumn("shard", shard_of("part", "pos")).withColumn("key", key).withColumn("block", block)
    starts = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks_of = sent.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    first = blocks_of.select("shard", "block", F.coalesce(F.sum("n").over(starts), F.lit(0)).alias("first"))
    if shards * blocks <= SMALL_TABLE:
        first = F.broadcast(first)
    order = Window.partitionBy("shard", "block").orderBy("key", "part", "pos")
    ranked = sent.withColumn("rank", F.row_number().over(order)).join(first, ["shard", "block"])
    kept = [F.col("row")[c].alias(c) for c in rows.columns if c.lower() not in ("shard", "slot")]
    return ranked.select(*kept, "shard", (F.col("first") + F.col("rank") - 1).alias("slot"))
