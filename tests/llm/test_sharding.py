import numpy as np

from marginalia.llm.sharding import communication_matrix, hypergeometric, shuffle_into_shards
from tests.llm.rows import awkward, documents


def test_matrix_has_exact_margins():
    matrix = communication_matrix([5, 0, 17, 40], 7, seed=3)
    assert matrix.sum(axis=1).tolist() == [5, 0, 17, 40]
    columns = matrix.sum(axis=0)
    assert columns.max() - columns.min() <= 1 and matrix.min() >= 0


def test_large_draws_agree_with_small_ones(monkeypatch):
    rng = np.random.default_rng(1)
    small = [hypergeometric(rng, 300, 700, 200) for _ in range(4000)]
    monkeypatch.setattr("marginalia.llm.sharding.NUMPY_LIMIT", 0)
    large = [hypergeometric(rng, 300, 700, 200) for _ in range(4000)]
    assert abs(np.mean(small) - np.mean(large)) < 0.6 and abs(np.std(small) - np.std(large)) < 0.4
    assert hypergeometric(rng, 0, 5, 3) == 0 and hypergeometric(rng, 5, 0, 3) == 3
    huge = hypergeometric(rng, 3 * 10**9, 10**9, 10**6)
    assert abs(huge - 750_000) < 5_000


def test_rows_are_dealt_whole(spark):
    docs = documents(spark, awkward() * 7).repartition(3)
    shards = shuffle_into_shards(docs, 4, seed=5, block_rows=4)
    assert set(shards.columns) == set(docs.columns) | {"shard", "slot"}
    rows = shards.collect()
    key = lambda r: (str(r["doc_id"]), str(r["text"]), r["part"])
    assert sorted(map(key, rows)) == sorted(map(key, docs.collect()))
    by = [[r["slot"] for r in rows if r["shard"] == s] for s in range(4)]
    assert max(map(len, by)) - min(map(len, by)) <= 1
    assert all(sorted(slots) == list(range(len(slots))) for slots in by)


def test_every_place_is_equally_likely(spark):
    docs = spark.range(40, numPartitions=5).selectExpr("id AS doc_id", "'x' AS text")
    hits = np.zeros((40, 4))
    for seed in range(12):
        for r in shuffle_into_shards(docs, 4, seed).collect():
            hits[r["doc_id"], r["shard"]] += 1
    assert hits.sum(axis=0).tolist() == [120] * 4
    assert ((hits - 3) ** 2 / 3).sum() < 200  # chi square of 117 degrees


def test_empty(spark):
    assert shuffle_into_shards(documents(spark, []), 8).count() == 0
