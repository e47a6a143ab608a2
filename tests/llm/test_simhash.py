import random

import numpy as np
import pytest
import xxhash

from marginalia.llm import simhash
from marginalia.llm.simhash import as_hex, fingerprints, near_duplicates
from tests.llm.rows import awkward, documents, prose


def print_of(text):
    """By the definition, a bit at a time."""
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    for blank in "\t\n\v\f\r":
        low = low.replace(blank, " ")
    words = [w for w in low.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, prints):
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(prints):
        for j in range(i):
            if (x ^ prints[j]).bit_count() <= 3:
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted((str(d), f"{prints[i]:016x}", str(least.get(root(i)))) for i, (d, _) in enumerate(rows))


def found(df):
    return sorted((str(r[0]), r[1], str(r[2])) for r in df.select("doc_id", as_hex(df["fingerprint"]), "component_id").collect())


def test_fingerprints():
    texts = [t or "" for _, t in awkward()] + prose(3, 40) + ["A  b\tC d", "a b c d", "one two", "Ä ß x y"]
    assert fingerprints([t.encode() for t in texts]).tolist() == [print_of(t) for t in texts]


def test_blocks_of_shingles(monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 7)
    texts = prose(4, 30)
    assert fingerprints([t.encode() for t in texts]).tolist() == [print_of(t) for t in texts]


@pytest.mark.parametrize("crowd", [4096, 0])
def test_texts_against_brute_force(spark, crowd):
    rows = list(enumerate(prose(1, 200), 10)) + awkward()
    got = found(near_duplicates(documents(spark, rows), crowd=crowd))
    assert got == brute(rows, [print_of(t) for _, t in rows])


@pytest.mark.parametrize(("crowd", "pairs"), [(4096, 1 << 20), (3, 50), (0, 1 << 20)])
def test_planted_distances(spark, monkeypatch, crowd, pairs):
    """Fingerprints 1 to 4 bits from others, in dense balls and alone, with and without the second index."""
    monkeypatch.setattr(simhash, "PAIRS", pairs)
    rng = random.Random(5)
    prints = [0, (1 << 64) - 1]
    for _ in range(60):
        base = rng.getrandbits(64)
        for _ in range(rng.randrange(12)):
            value = base
            for bit in rng.sample(range(64), rng.randrange(5)):
                value ^= 1 << bit
            prints.append(value)
    # A ball whose members agree in one half and differ by up to three bits in the other.
    prints += [(0xABCD << 48) | 1 << a | 1 << b | 1 << c for a in range(0, 20, 2) for b in range(6) for c in range(3)]
    prints = sorted(set(prints))
    nodes = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fingerprint long")
    forest = simhash.linked_in_buckets(simhash.split_crowds(simhash.filed(nodes), nodes, crowd))
    labels = {r["node"]: r["component"] for r in simhash.components(forest).collect()}
    got = [labels.get(p - (1 << 64) if p >> 63 else p, i) for i, p in enumerate(prints)]
    want = [w[2] for w in sorted(brute(list(enumerate(prints)), prints), key=lambda w: int(w[0]))]
    assert [[a == b for b in got] for a in got] == [[a == b for b in want] for a in want]
    assert forest.count() <= 40 * len(prints)


def test_forest():
    a = np.array([5, 3, 9, -4], np.int64)
    b = np.array([3, 7, 8, -4], np.int64)
    nodes, least = simhash.forest(a, b)
    assert dict(zip(nodes.tolist(), least.tolist())) == {5: 3, 7: 3, 9: 8}


def test_empty(spark):
    assert near_duplicates(documents(spark, [])).collect() == []
    assert found(near_duplicates(documents(spark, [(3, None), (2, "")]))) == [("2", "0" * 16, "2"), ("3", "0" * 16, "2")]
