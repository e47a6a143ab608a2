import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from marginalia.llm import language
from marginalia.llm.language import features, held_out, identify, learn
from tests.llm.rows import awkward, documents

ALPHABETS = {"xa": "abcde ", "xb": "cdefgh ", "xc": "ñéüö ab "}


def text(rng, lang, size):
    return "".join(rng.choice(ALPHABETS[lang]) for _ in range(size))


def labelled(spark):
    rng = random.Random(1)
    rows = [(i, text(rng, lang, 300), lang) for i, lang in enumerate(list(ALPHABETS) * 30)] + [(900, None, "xa"), (901, "abc", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_mixtures(spark):
    model = learn(labelled(spark))
    assert model.languages == sorted(ALPHABETS)
    rng = random.Random(2)
    mixed = text(rng, "xa", 700) + " " + text(rng, "xc", 300)
    rows = [(i, text(rng, lang, 200)) for i, lang in enumerate(list(ALPHABETS) * 10)]
    got = {r["doc_id"]: r for r in identify(documents(spark, [*rows, (500, mixed)]), model).collect()}
    assert all(got[i]["lang_pred"] == lang for i, lang in enumerate(list(ALPHABETS) * 10))
    assert got[500]["lang_pred"] == "xa" and 0.5 < got[500]["score"] < 0.9


def test_awkward_rows(spark):
    model = learn(labelled(spark))
    docs = documents(spark, [*awkward(), (50, "123 !? \U0001f642")])
    rows = identify(docs, model)
    assert set(rows.columns) == (set(docs.columns) - {"text"}) | {"lang_pred", "score"}
    got = {str(r["doc_id"]): (r["lang_pred"], r["score"]) for r in rows.filter("doc_id is not null").collect()}
    assert got["1"] == got["2"] == got["3"] == got["50"] == ("und", 0.0)
    assert identify(documents(spark, []), model).count() == 0
    nothing = learn(labelled(spark).limit(0))
    assert {r["lang_pred"] for r in identify(docs, nothing).collect()} == {"und"}


def test_shortest_texts(spark):
    """One or two letters are a text of some language, whatever stands beside them; a text without a letter is of none."""
    model = learn(labelled(spark))
    letters = ["a", "ok", "é", "e", "漢", "a!", "1a", "ß"]
    rows = list(enumerate(letters)) + [(100 + i, t) for i, t in enumerate(["", " ", "1", "!!", "12 34", "🙂"])]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in identify(documents(spark, rows), model).collect()}
    assert all(got[i][0] in ALPHABETS and 0 < got[i][1] <= 1 for i in range(len(letters)))
    assert all(got[100 + i] == ("und", 0.0) for i in range(6))
    assert got[0] == got[5]


def trigrams(text):
    """By the definition: ASCII letters small, other ASCII blank, bytes beyond as they are, a blank at both ends."""
    data = bytes(b if b >= 128 or 97 <= b < 123 else b + 32 if 65 <= b < 91 else 32 for b in f" {text} ".encode())
    every = [data[i : i + 3] for i in range(len(data) - 2)]
    return [(int.from_bytes(t, "big") * 2654435761 % 2**32) >> 16 for t in every if t != b"   "]


def em(p, n):
    share = [1 / len(p[0])] * len(p[0])
    for _ in range(language.ROUNDS):
        new = [0.0] * len(share)
        for line, count in zip(p, n):
            mixed = sum(a * b for a, b in zip(line, share))
            for k, a in enumerate(line):
                new[k] += share[k] * a * count / mixed / sum(n)
        moved = max(abs(a - b) for a, b in zip(new, share))
        share = new
        if moved < 1e-4:
            break
    return share, sum(count * math.log(sum(a * b for a, b in zip(line, share))) for line, count in zip(p, n))


def brute(text, counts, languages, size=language.BUCKETS):
    found = Counter(t // (language.BUCKETS // size) for t in trigrams(text))
    folded = {lang: Counter() for lang in languages}
    for lang in languages:
        for t, c in counts[lang].items():
            folded[lang][t // (language.BUCKETS // size)] += c
    seen = sorted(found)
    n = [found[t] for t in seen]
    p = [[(folded[lang][t] + language.SMOOTHING) / (sum(folded[lang].values()) + language.SMOOTHING * size) for lang in languages] for t in seen]
    lead = sorted(range(len(languages)), key=lambda k: -em(p, n)[0][k])
    best = None
    for k in range(1, len(lead) + 1):
        share, likelihood = em([[line[i] for i in lead[:k]] for line in p], n)
        value = likelihood - language.PENALTY * math.log(1 + sum(n)) * k
        if best is not None and value <= best[0]:
            break
        best = (value, lead[:k], share)
    top = max(range(len(best[1])), key=lambda i: best[2][i])
    return languages[best[1][top]], best[2][top]


def check_by_brute_force(spark, size):
    rng = random.Random(6)
    rows = [(i, text(rng, lang, rng.randrange(1, 60)), lang) for i, lang in enumerate(list(ALPHABETS) * 8)] + [(99, "", "xb"), (98, "É Ab", "xc")]
    model = learn(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3))
    counts = {lang: Counter(t for _, s, own in rows if own == lang for t in trigrams(s)) for lang in ALPHABETS}
    assert len(model.probability) == size and model.languages == sorted(ALPHABETS)
    texts = [text(rng, lang, rng.randrange(1, 80)) for lang in list(ALPHABETS) * 6]
    texts += [text(rng, "xa", 200) + text(rng, "xc", rng.randrange(50, 400)) for _ in range(6)] + ["a", "é b", "ABC", "one, two"]
    buckets, firsts = features([t.encode() for t in texts])
    for t, a, b in zip(texts, firsts[:-1], firsts[1:]):
        assert Counter(buckets[a:b].tolist()) == Counter(trigrams(t))
        if any(c.isalpha() for c in t):
            name, score = model.predict(buckets[a:b])
            want, share = brute(t, counts, model.languages, size)
            assert name == want and np.isclose(score, share, atol=1e-9)


def test_counts_mixtures_and_choice_by_brute_force(spark):
    check_by_brute_force(spark, language.BUCKETS)


def test_many_languages_share_the_model(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_CELLS", 3 * 4096 + 5)
    check_by_brute_force(spark, 4096)


def test_held_out_accuracy(spark):
    import __spark_entry__ as contract

    folder = "/root/testdata/sf0.01"
    got = contract.queries()["op6_languages"](spark, folder)
    known = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    held = got.join(known, "doc_id").filter("held_out and lang is not null")
    right, total = held.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count(F.lit(1))).first()
    assert total > 100 and right / total > 0.97
    assert got.filter("score < 0 or score > 1").count() == 0
    share = got.filter(held_out(F.col("doc_id")) != F.col("held_out")).count()
    assert share == 0
