import random
import re
import tracemalloc

import pytest

from marginalia.llm.decontaminate import TestSuffixes, drop_contaminated, find_benchmark, matches
from tests.llm.rows import awkward, documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items, window):
    result = []
    for doc_id, text in docs:
        words, hit, names = words_of(text), set(), set()
        for name, item in items:
            known = words_of(item)
            size = min(window, len(known))
            wanted = {tuple(known[i : i + size]) for i in range(len(known) - size + 1)} if size else set()
            for i in range(len(words) - size + 1):
                if tuple(words[i : i + size]) in wanted:
                    hit.update(range(i, i + size))
                    names.add(name)
        result.append((str(doc_id), len(words), len(hit), tuple(sorted(str(n) for n in names if n is not None))))
    return sorted(result)


def found(df):
    rows = [(str(r["doc_id"]), r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), tuple(r["items"])) for r in df.collect()]
    return sorted(rows)


def random_text(rng, least, most):
    return " ".join(rng.choice(["a", "B", "ça", "d4", "e-f", "gg"]) for _ in range(rng.randint(least, most)))


def test_against_brute_force_in_one_and_many_blocks(spark):
    rng = random.Random(4)
    items = [(i, random_text(rng, 0, 9)) for i in range(25)] + [(99, None), (98, ""), (None, "a B a"), (3, "gg")]
    rows = [(i, random_text(rng, 0, 60)) for i in range(60)] + awkward()
    docs, table = documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    for window in (3, 5):
        expected = brute(rows, items, window)
        assert found(find_benchmark(docs, table, window)) == expected
        assert found(find_benchmark(docs, table, window, item_bytes=400)) == expected


def test_longest_match(spark):
    items = spark.createDataFrame([(1, "p q r s t u v"), (2, "x y z")], "item_id long, text string")
    docs = documents(spark, [(1, "k q R s, t u k x y z"), (2, "nothing")])
    rows = {r["doc_id"]: r for r in find_benchmark(docs, items, 3).collect()}
    assert (rows[1]["longest"], rows[1]["longest_item"], rows[1]["longest_start"]) == (5, "1", 1)
    assert rows[2]["longest"] == 0 and rows[2]["longest_item"] is None and rows[2]["spans"] == []


def longest_of(text, items, window):
    """(length, item, place) of the first longest match that holds a window, by comparing all places."""
    words, best = words_of(text), (0, None, None)
    for s in range(len(words)):
        for name, item in sorted(items, key=lambda i: (i[0] is not None, str(i[0]), i[1] or "")):
            known = words_of(item)
            for o in range(len(known)):
                n = 0
                while s + n < len(words) and o + n < len(known) and words[s + n] == known[o + n]:
                    n += 1
                if (n >= window or (o == 0 and 0 < n == len(known) < window)) and n > best[0]:
                    best = (n, name, s)
    return best


@pytest.mark.parametrize("seed", range(4))
def test_longest_matches_by_brute_force(seed):
    rng = random.Random(seed)
    items = [(str(i), random_text(rng, 0, 14)) for i in range(20)] + [("30", "a a a a a a a"), ("31", "a a a a a a a"), ("32", "gg")]
    items = sorted(items)
    tests = TestSuffixes([(n, t.encode()) for n, t in items], 4)
    texts = [random_text(rng, 0, 40) for _ in range(40)] + ["a " * 30, "", "zz a a a a zz", "gg", items[3][1] + " " + items[5][1]]
    got = matches(tests, [t.encode() for t in texts])
    for i, t in enumerate(texts):
        want = longest_of(t, items, 4)
        assert (got["longest"][i], got["longest_item"][i], got["longest_start"][i]) == want


def test_a_benchmark_that_repeats_itself(spark):
    """One word over and over, in the item and in the document: a place is one row, not one per place of the item."""
    tests = TestSuffixes([("i", b"a " * 1000), *[(f"j{i}", b"a " * 50) for i in range(100)]], 10)
    assert len(tests.low) == 1
    tracemalloc.start()
    got = matches(tests, [b"a " * 500_000, b"b " + b"a " * 20])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500e6
    assert got["longest"] == [1000, 20] and got["longest_item"] == ["i", "i"] and len(got["items"][0]) == 101
    assert got["spans"][0] == [{"start": 0, "end": 500_000}] and got["spans"][1] == [{"start": 1, "end": 21}]


def test_many_words(spark):
    """A vocabulary of so many words that a window needs several keys."""
    rng = random.Random(9)
    items = [(i, " ".join(f"n{rng.randrange(10**6)}" for _ in range(30))) for i in range(400)]
    rows = [(i, "lead " + " ".join(items[i][1].split()[5 : 5 + i % 20])) for i in range(0, 400, 3)]
    table = spark.createDataFrame(items, "item_id long, text string")
    assert found(find_benchmark(documents(spark, rows), table, 10)) == brute(rows, items, 10)


def test_drop_keeps_columns_and_empty_tables(spark):
    items = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    docs = documents(spark, [(1, "zero One two three"), (2, "one two"), (None, None)])
    left = drop_contaminated(docs, items, 3)
    assert left.columns == docs.columns and sorted(str(r["doc_id"]) for r in left.collect()) == ["2", "None"]
    assert drop_contaminated(documents(spark, []), items).count() == 0
    assert drop_contaminated(docs, items.limit(0)).count() == 3
