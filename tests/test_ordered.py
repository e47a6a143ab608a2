"""Windows over large groups give what ordinary windows give."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from marginalia.operators.ordered import OrderedGroups, centred_mean, split_hot, with_rank


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = [("hot" if rng.random() < 0.6 else rng.choice(["a", "b", None]), i, rng.randrange(50), rng.random()) for i in range(2000)]
    rng.shuffle(data)
    return spark.createDataFrame(data, "k string, i bigint, t int, v double").repartition(6)


def test_split_hot(rows):
    cold, hot, count = split_hot(rows, ["k"], 1000)
    assert {r.k for r in hot.select("k").distinct().collect()} == {"hot"}
    assert hot.count() == count
    assert cold.count() + count == 2000
    assert split_hot(rows, ["k"], 5000)[1] is None


@pytest.mark.parametrize("limit", [100, 1000])
def test_running_columns(rows, limit):
    w = Window.partitionBy("k").orderBy("t", "i")
    up_to = w.rowsBetween(Window.unboundedPreceding, 0)
    flag = F.when(F.col("v") > 0.9, F.col("i"))
    expected = rows.select(
        "i", F.row_number().over(w).alias("n"), F.sum("t").over(up_to).alias("s"), F.lag("i").over(w).alias("p"), F.max(flag).over(up_to).alias("m")
    )
    groups = OrderedGroups(rows, ["k"], ["t", "i"], limit)
    assert groups.hot
    actual = groups.row_number("n").running_sum("s", F.col("t")).previous("p", F.col("i")).running_max("m", flag).result()
    assert sorted(map(tuple, actual.select("i", "n", "s", "p", "m").collect())) == sorted(map(tuple, expected.collect()))


def test_centred_mean(rows):
    plain = centred_mean(rows, ["k"], ["t", "i"], F.col("v"), "mean", 4)
    cut = centred_mean(rows, ["k"], ["t", "i"], F.col("v"), "mean", 4, limit=60)

    def result(df):
        return {r.i: round(r["mean"], 9) for r in df.collect()}

    assert result(plain) == result(cut)


@pytest.mark.parametrize("limit", [5, 20, 1000])
def test_running_columns_over_nulls(spark, limit):
    data = [("k", i, None if i < 7 or 20 < i < 45 or i % 4 == 0 else i) for i in range(60)] + [("n", i, None) for i in range(30)]
    df = spark.createDataFrame(data, "k string, i bigint, v bigint").repartition(3)
    w = Window.partitionBy("k").orderBy("i")
    w = w.rowsBetween(Window.unboundedPreceding, 0)
    groups = OrderedGroups(df, ["k"], ["i"], limit).running_sum("s", F.col("v")).running_max("m", F.col("v")).previous("p", F.col("v"))
    expected = df.select("k", "i", F.sum("v").over(w).alias("s"), F.max("v").over(w).alias("m"), F.lag("v").over(Window.partitionBy("k").orderBy("i")).alias("p"))
    columns = ["k", "i", "s", "m", "p"]
    assert sorted(groups.result().select(columns).collect(), key=str) == sorted(expected.collect(), key=str)


def test_rank_over_many_ranges(spark):
    """Ties settled by the second key, nulls, texts in locale order; the ranks are those of the whole."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rng = random.Random(4)
        rows = [(rng.choice([None, rng.randrange(9), 5, 5, 5]), i) for i in range(400)]
        df = spark.createDataFrame(rows, "v int, id int").repartition(5)
        ranked = with_rank(df, [F.col("v").desc(), F.col("id").asc()])
        assert ranked.select(F.spark_partition_id()).distinct().count() > 1
        want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
        assert [(r.v, r.id) for r in sorted(ranked.collect(), key=lambda r: r["rank"])] == want
        assert sorted(r["rank"] for r in ranked.collect()) == list(range(1, 401))
        names = ["b", "a", "A", "é", "e", "E", "É", "f", "Z", "z", "ab"]
        named = with_rank(spark.createDataFrame([(n,) for n in names], "n string").repartition(4), [F.collate("n", "UNICODE").asc()])
        assert [r.n for r in sorted(named.collect(), key=lambda r: r["rank"])] == ["a", "A", "ab", "b", "e", "E", "é", "É", "f", "z", "Z"]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert with_rank(df.limit(0), [F.col("id").asc()]).collect() == []
