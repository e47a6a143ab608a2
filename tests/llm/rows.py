"""Small tables of awkward rows: nulls, empty and long texts, ties, repeated rows, columns with clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, part int, home int, kept string, key long"


def documents(spark, rows):
    """``rows`` of (doc_id, text) with all columns of documents and some whose names operators use themselves."""
    full = [(d, t, "en" if i % 3 else None, "s" if i % 2 else None, len(t or ""), "r", i, 7, "k", None) for i, (d, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def awkward():
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    return [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (None, "two words"), (5, long), (5, long), (6, long), (7, "é ß ñ 漢字 🙂"), (None, None)]


def prose(seed, documents, words=120, vocabulary=400):
    """Random texts, some of them copies of others with a few words changed."""
    rng = random.Random(seed)
    texts = []
    for _ in range(documents):
        if texts and rng.random() < 0.5:
            base = rng.choice(texts).split(" ")
            for _ in range(rng.choice([0, 1, 3, 8, 20])):
                base[rng.randrange(len(base))] = f"v{rng.randrange(vocabulary)}"
            texts.append(" ".join(base))
        else:
            texts.append(" ".join(f"v{rng.randrange(vocabulary)}" for _ in range(rng.randint(1, words))))
    return texts
