import random
from itertools import permutations

import numpy as np
import pytest

from marginalia.llm import audit
from marginalia.llm.audit import figures, first_spans, same_bytes, transduce
from tests.llm.rows import awkward, documents, prose

LABELS = "doc_id long, quality int, toxic int, text string"


def words_of(text):
    for blank in "\t\n\v\f\r":
        text = text.replace(blank, " ")
    return [w for w in text.split(" ") if w]


def fails_of(text):
    words = words_of(text)
    tests = [
        len(words) < 200,
        100 * len(set(words)) < 50 * len(words),
        100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
        any(c in "#$%&*|" for c in text),
    ]
    return {f for f, t in zip("ABCD", tests) if t}


def brute(rows, labels):
    """``rows`` of (doc_id, text, source), by applying every order to every document."""
    found = []
    for d, t, s in rows:
        failed = fails_of(t or "")
        if d is not None and any(o is not None and o < d and (u or "") == (t or "") for o, u, _ in rows):
            failed.add("E")
        good = any(q == 1 for i, q, _, _ in labels if i is not None and i == d)
        toxic = any(x == 1 for i, _, x, _ in labels if i is not None and i == d)
        found.append((s or "", failed, good, toxic))
    result, shapley = {}, {}
    for part in {p for p, *_ in found}:
        own = [(f, g, x) for p, f, g, x in found if p == part]
        for order in permutations("ABCDE"):
            left = own
            for step, name in enumerate(order, 1):
                gone = [o for o in left if name in o[0]]
                failing = sum(name in f for f, _, _ in own)
                left = [o for o in left if name not in o[0]]
                row = [len(left), len(gone), failing - len(gone), sum(f == {name} for f, _, _ in own), sum(g for _, g, _ in gone), sum(x for _, _, x in gone)]
                result[part, "".join(order), step] = row
                shapley[part, name] = shapley.get((part, name), 0) + len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in result.items()}


def found(df):
    columns = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in columns) for r in df.collect()}


def mixed_texts():
    rng = random.Random(8)
    texts = prose(6, 60, words=400, vocabulary=900)
    texts += [" ".join(rng.choice(["a", "Bb", "cc#"]) for _ in range(rng.randrange(300))) for _ in range(20)]
    texts += ["A" * 50 + " " + " ".join(f"x{i}" for i in range(250)), "x|y " * 300, "É" * 100, "ab cd " * 250]
    return texts + texts[::3] + texts[::7]


def test_figures():
    texts = [t or "" for _, t in awkward()] + mixed_texts() + ["\x00 a\x00b", "a\vb\fc\x1fd", "🙂🙂 🙂", "w" * 9000 + " " + "w" * 9000]
    got = figures([t.encode() for t in texts])
    for i, t in enumerate(texts):
        words = words_of(t)
        want = [len(words), len(set(words)), sum("A" <= c <= "Z" for c in t), len(t), sum(c in "#$%&*|" for c in t)]
        assert [int(v[i]) for v in got.values()] == want


def test_transducer_steps():
    """The look-up of a whole batch is the step-by-step run of the tables."""
    data = np.frombuffer(random.Random(1).randbytes(5000), np.uint8)
    state, want = audit.BETWEEN, []
    for byte in data.tolist():
        want.append(int(audit.EMIT[state, byte]))
        state = int(audit.NEXT[byte])
    assert transduce(data).tolist() == want


def test_table_verifies_words():
    """All spans under one hash: only the bytes tell them apart."""
    words = [b"aa", b"ab", b"aa", b"a", b"abcdefghi", b"abcdefghj", b"abcdefghi", b"ab"]
    data = np.frombuffer(b" ".join(words), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - [len(w) for w in words]
    same = np.zeros(len(words), np.uint64)
    assert first_spans(data, starts, ends, np.zeros(len(words), int), same).tolist() == [True, True, False, True, True, True, False, False]
    owners = np.array([0, 0, 1, 1, 1, 1, 1, 1])
    assert first_spans(data, starts, ends, owners, same).tolist() == [True, True, True, True, True, True, False, True]


def test_same_bytes():
    data = np.frombuffer(b"abcdefgh1abcdefgh2" + bytes(8), np.uint8)
    assert same_bytes(data, np.array([0, 0, 0]), np.array([9, 9, 0]), np.array([8, 9, 0])).tolist() == [True, False, True]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    texts = mixed_texts()
    rows = [(rng.choice([i, i, i, None]), t, rng.choice(["hot", "hot", "b", "", None])) for i, t in enumerate(texts)]
    rows += rows[5:9] + [(5, "another text of the same number", "b")] + [(d, t, "odd") for d, t in awkward()]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None]), "x") for i in range(0, 80, 2)] + [(4, 1, 0, "x"), (4, 0, 1, "x"), (None, 1, 1, "x"), (9999, 1, 1, "x")]
    docs = documents(spark, [(d, t) for d, t, _ in rows])
    docs = spark.createDataFrame([(*r[:3], s, *r[4:]) for r, (_, _, s) in zip(docs.collect(), rows)], docs.schema)
    assert found(audit.audit(docs, spark.createDataFrame(labels, LABELS))) == brute(rows, labels)


def test_empty(spark):
    labels = spark.createDataFrame([], LABELS)
    assert audit.audit(documents(spark, []), labels).collect() == []
    one = found(audit.audit(documents(spark, [(1, None)]), labels))
    assert len(one) == 600 and one["", "ABCDE", 1] == (0, 1, 0, 1, 0, 0, 120)
