import random
import re

from marginalia.llm.quality import judge_quality, keep_good
from tests.llm.rows import awkward, documents


def brute(text):
    text = text or ""
    words = [w for w in re.split("[ \t-\r]+", text) if w]
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {p for starts in windows.values() if len(starts) > 1 for i in starts for p in range(i, i + 8)}
    lines = [line for line in text.split("\n") if re.search("[^ \t-\r]", line)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    base = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), base


def test_figures(spark):
    rng = random.Random(6)
    texts = []
    for _ in range(150):
        parts = [" ".join(rng.choice(["a", "the", "x#", "ñandú", "|", "🙂"]) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 6))]
        texts.append(rng.choice(["\n", " ", "\r\n", "\n \n", "\t"]).join(parts * rng.choice([1, 1, 2])))
    rows = list(enumerate(texts, 10)) + awkward()
    got = judge_quality(documents(spark, rows))
    fields = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert sorted((str(r["doc_id"]), *[r[f] for f in fields]) for r in got.collect()) == sorted((str(d), *brute(t)) for d, t in rows)


def test_verdicts(spark):
    clean = "The house stands on a hill and the road to it is long. People of the town walk there in summer, and children run to the river."
    bad = {
        "symbols": " ".join(w + "***" for w in clean.split()),
        "stop_words": " ".join(f"zq{i} wx{i}" for i in range(20)),
        "repeated_lines": "\n".join(["The one line of it is here."] * 2 + ["And the other of them is there."] * 2) + "\n" + "that is it and the rest " + "of this is for us",
        "cut_lines": "\n".join(f"The story of the {w} and so on..." for w in clean.split()[:8]),
    }
    docs = documents(spark, [(0, clean), *enumerate(bad.values(), 1)])
    rows = {r["doc_id"]: r for r in judge_quality(docs).collect()}
    assert rows[0]["kept"] and rows[0]["failed_rules"] == []
    for i, name in enumerate(bad, 1):
        assert name in rows[i]["failed_rules"] and not rows[i]["kept"]
    left = keep_good(docs)
    assert left.columns == docs.columns and [r["doc_id"] for r in left.collect()] == [0]
    assert keep_good(documents(spark, [])).count() == 0


def test_clean_texts_stay(spark):
    """Languages with stop words of their own, scripts without listed words, and a few short lines repeated."""
    sentence = "The house stands on a hill and the road to it is long, so people of the town walk there in summer and rest by the river"
    other = "Nobody knows which of them came first or why it was built there, but all agree that this is the best place for a view"
    texts = [
        "Дом стоит на холме, и дорога к нему длинная. Люди из города ходят туда летом, а дети бегут к реке, но это не так далеко, как он думает.",
        "La casa sta su una collina e la strada che porta al paese è lunga, ma gli abitanti della valle non sono soli: anche nel bosco il sentiero va avanti.",
        "Dom stoi na wzgórzu i droga do miasta jest długa, ale ludzie nie boją się tego, że w lesie z rana jest zimno jak w zimie.",
        " ".join(["पहाड़ी पर एक घर है और रास्ता लंबा है"] + [f"शब्द{i}" for i in range(20)]),
        "\n".join([sentence, "yes", "no", "yes", "no", "yes", other, "yes"]),
    ]
    docs = documents(spark, list(enumerate(texts)))
    rows = {r["doc_id"]: r for r in judge_quality(docs).collect()}
    assert {i: r["failed_rules"] for i, r in rows.items()} == {i: [] for i in range(5)}
    assert rows[4]["n_dup_lines"] == 4 and all(not r["base_failed"] for r in rows.values())
    assert keep_good(docs).count() == 5


def test_no_user_functions(spark):
    plan = judge_quality(documents(spark, [(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
