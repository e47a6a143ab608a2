import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import neardup
from marginalia.llm.components import chains, components, connected
from marginalia.llm.neardup import keep_one, near_duplicates, shingle_sets, similarity, sketch
from tests.llm.rows import awkward, documents, prose


def sets_of(text, words):
    parts = "".join(c.lower() if c.isascii() else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ")
    parts = [p for p in parts if p]
    if not parts:
        return set()
    return {tuple(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))}


def brute(rows, words, percent):
    """(doc_id, set size, component, kept) as text, by comparing all pairs."""
    known = [(d, sets_of(t, words)) for d, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (a, x) in enumerate(known):
        for j in range(i):
            b, y = known[j]
            if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(known):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    result = []
    for i, (d, x) in enumerate(known):
        component = None if d is None else least[root(i)]
        result.append((str(d), len(x), str(component), d is None or d == component))
    return sorted(result)


def found(df):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["kept"]) for r in df.collect())


@pytest.mark.parametrize(("words", "seed"), [(2, 1), (5, 2)])
def test_against_brute_force(spark, words, seed):
    rows = list(enumerate(prose(seed, 250), 10)) + awkward()
    assert found(near_duplicates(documents(spark, rows), words)) == brute(rows, words, 80)


def test_chain_and_hub(spark):
    """Neighbours of a chain are alike, its ends are not; copies of one text differ more from each other than from it."""
    chain = [" ".join(f"c{i + k}" for i in range(60)) for k in range(0, 60, 4)]
    base = [f"b{i}" for i in range(100)]
    spokes = [" ".join(base[:i] + [f"x{i}"] + base[i + 1 : i + 4] + [f"y{i}", f"z{i}"] + base[i + 6 :]) for i in range(0, 90, 6)]
    rows = list(enumerate(chain + spokes)) + [(500, " ".join(base))]
    got = found(near_duplicates(documents(spark, rows), 2))
    assert got == brute(rows, 2, 80)


def test_blocks_of_a_bucket(spark, monkeypatch):
    """Groups larger than a block, and groups in which the first star leaves parts unconnected."""
    monkeypatch.setattr(neardup, "BLOCK", 4)
    rows = list(enumerate(prose(7, 150, words=60, vocabulary=60)))
    rng = np.random.default_rng(3)
    base = [f"g{i}" for i in range(80)]
    for k in range(60):
        text = list(base)
        for place in rng.integers(0, 80, int(rng.integers(2, 9))):
            text[place] = f"h{rng.integers(0, 30)}"
        rows.append((1000 + k, " ".join(text)))
    assert found(near_duplicates(documents(spark, rows), 2)) == brute(rows, 2, 80)


def test_estimate_is_close():
    rng = np.random.default_rng(2)
    for share in (0.3, 0.6, 0.8, 0.95):
        errors = []
        for _ in range(20):
            both = rng.integers(0, 2**63, 1000, dtype=np.uint64)
            n = int(round(1000 * share))
            rest = (1000 - n) // 2
            a, b = both[: n + rest], np.concatenate([both[:n], both[n + rest :]])
            x, y = sketch([np.sort(a)])[0], sketch([np.sort(b)])[0]
            union = sketch([np.unique(np.concatenate([a, b]))])[0]
            assert (np.maximum(x, y) == union).all()
            value = similarity(np.array([(x > y).sum()]), np.array([(x < y).sum()]), np.array([len(a)]), np.array([len(b)]))
            errors.append(float(value[0]) - n / len(both))
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.07


def test_sets():
    sets = shingle_sets([b"A b c", b"a B  C", b"b", b"", b"b b", b"a b a b"], 2)
    assert [len(s) for s in sets] == [2, 2, 1, 0, 1, 2]
    assert (sets[0] == sets[1]).all() and sets[2][0] != sets[4][0]


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(60, 50), (50, 55), (70, 71), (71, 70), (80, 80)] + [(100, i) for i in range(101, 130)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 50: 50, 55: 50, 60: 50, 70: 70, 71: 70, **{i: 100 for i in range(100, 130)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_chains_and_added_links(spark):
    parents = [(0, 1), (1, 2), (2, 9), (9, 11), (3, 4), (20, 21)]
    found = chains(spark.createDataFrame(parents, "a long, b long"))
    expected = {**dict.fromkeys([0, 1, 2, 9, 11], 0), 3: 3, 4: 3, 20: 20, 21: 20}
    assert {r["node"]: r["component"] for r in found.collect()} == expected
    more = connected(found, spark.createDataFrame([(4, 11), (30, 21), (31, 32)], "a long, b long"))
    expected |= {3: 0, 4: 0, 30: 20, 31: 31, 32: 31}
    assert {r["node"]: r["component"] for r in more.collect()} == expected and more.count() == len(expected)
    nothing = found.select("node", "component").limit(0)
    assert connected(nothing, spark.createDataFrame([], "a long, b long")).count() == 0
    assert chains(spark.createDataFrame([], "a long, b long")).count() == 0


def test_short_texts_of_few_words(spark):
    """Many texts alike by less than the threshold, so that components meet in shared buckets."""
    rows = list(enumerate(prose(11, 160, words=40, vocabulary=30)))
    assert found(near_duplicates(documents(spark, rows), 2)) == brute(rows, 2, 80)


def test_documents_of_one_hash(spark, monkeypatch):
    """All documents share the hash that texts are fetched by: the digests still tell their sets apart."""
    monkeypatch.setattr(neardup, "row_key", lambda: F.lit(7).cast("long"))
    rows = list(enumerate(prose(12, 60, words=60), 10)) + awkward()
    assert found(near_duplicates(documents(spark, rows), 2)) == brute(rows, 2, 80)


def test_keep_one(spark):
    rows = [(5, "a b c d e f g"), (3, "a b c d e f g"), (3, "a b c d e f g"), (9, "other words are here too"), (None, "x"), (None, "x"), (4, None)]
    docs = documents(spark, rows)
    left = keep_one(docs)
    assert left.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == ["3", "4", "9", "None", "None"]
    assert keep_one(documents(spark, [])).count() == 0
    assert near_duplicates(documents(spark, [])).count() == 0


def test_texts_that_share_a_doc_id(spark):
    one, two = "a b c d e f g h i j k l m n", "p q r s t u v w x y z aa bb cc"
    rows = [(1, one), (1, two), (1, two), (2, one + " o"), (3, two + " dd"), (4, "other words stand here"), (5, ""), (5, None), (6, one), (6, one + " o")]
    docs = documents(spark, rows)
    judged = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_duplicates(docs, 2).collect()}
    assert judged == {(1, 13, 1), (2, 14, 1), (3, 14, 1), (4, 3, 4), (5, 0, 5), (6, 13, 1), (6, 14, 1)}
    assert sorted((r["doc_id"], r["text"] or "") for r in keep_one(docs, 2).collect()) == [(1, one), (1, two), (4, "other words stand here"), (5, "")]


def test_texts_of_one_doc_id_link_nothing(spark):
    one, two = "a b c d e f g h i j k l m n", "p q r s t u v w x y z aa bb cc"
    rows = [(5, one), (5, two), (7, one + " o"), (3, two + " dd")]
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_duplicates(documents(spark, rows), 2).collect()}
    assert got == {(5, 13, 5), (5, 13, 3), (7, 14, 5), (3, 14, 3)}
