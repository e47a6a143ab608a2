import random

import numpy as np

import pytest

from marginalia.llm import substrings
from marginalia.llm.substrings import duplicate_spans, without_repeats
from marginalia.llm.suffixes import shared_prefix, suffix_order
from tests.llm.rows import awkward, documents



def brute(rows, length):
    least = {}
    for d, t in rows:
        raw = (t or "").encode()
        for i in range(len(raw) - length + 1) if d is not None else ():
            w = raw[i : i + length]
            least[w] = min(d, least.get(w, d))
    result = []
    for d, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1) if d is not None else ():
            if least[raw[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        result.append((str(d), len(raw), sum(gone), spans, kept))
    return sorted(result)


def found(df):
    return sorted((str(r["doc_id"]), r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), bytes(r["kept"])) for r in df.collect())


def corpus(seed, count):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(20, 140))) for _ in range(12)]
    rows = []
    for i in range(count):
        parts = [rng.choice(passages) if rng.random() < 0.5 else "".join(rng.choice("abcdé \n") for _ in range(rng.randint(0, 90))) for _ in range(5)]
        rows.append((rng.randint(0, 3 * count) if rng.random() < 0.9 else i, "".join(parts)))
    rows += [(1000 + i, "z" * rng.randint(0, 200)) for i in range(6)] + [(2000 + i, "ab" * rng.randint(0, 90)) for i in range(4)]
    return rows


@pytest.mark.parametrize("hot", [5000, 3])
def test_against_brute_force(spark, monkeypatch, hot):
    """With the usual limit, and with nearly all repeated anchors hot and several homes, counters and sorters."""
    if hot < 100:
        monkeypatch.setattr(substrings, "LEAST_HOT", hot)
        for name, size in (("HOME_BYTES", 5000), ("COUNT_BYTES", 6000), ("SORT_BYTES", 4000), ("PORTION", 700)):
            monkeypatch.setattr(substrings, name, size)
    rows = corpus(hot, 120) + awkward()
    assert found(duplicate_spans(documents(spark, rows).repartition(3), 50)) == brute(rows, 50)


def test_other_length(spark):
    rows = corpus(77, 60)
    assert found(duplicate_spans(documents(spark, rows), 30)) == brute(rows, 30)


def test_text_and_columns(spark):
    shared = "é" * 40
    docs = documents(spark, [(1, shared + "one"), (2, "two" + shared), (3, "x" + shared[:25] + "ñ"), (None, shared), (4, None)])
    left = without_repeats(docs, 50)  # of ñ the first byte is part of a match
    assert left.columns == docs.columns
    assert {str(r["doc_id"]): r["text"] for r in left.collect()} == {"1": shared + "one", "2": "two", "3": "x", "None": shared, "4": ""}
    assert duplicate_spans(documents(spark, []), 50).count() == 0


def test_suffix_order():
    rng = random.Random(3)
    for _ in range(150):
        letters, data, wanted, length = rng.choice([1, 2, 3, 5]), [], [], 10
        for _ in range(rng.randint(1, 8)):
            piece = [rng.randint(97, 96 + letters) for _ in range(rng.randint(length, 60))]
            wanted += range(len(data), len(data) + len(piece) - length + 1)
            data += [*piece, 255]
        raw = np.array(data, dtype=np.uint8)
        order = suffix_order(raw, np.array(wanted), length)
        keys = [bytes(data[i : i + length]) for i in order]
        assert sorted(order) == wanted and keys == sorted(keys)
        assert shared_prefix(raw, order, length).tolist() == [False] + [a == b for a, b in zip(keys, keys[1:], strict=False)]
