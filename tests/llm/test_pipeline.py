"""The pipeline on a small corpus, beside the stages done by brute force."""

import os
import random
import uuid

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from marginalia.llm.quality import judge_quality
from marginalia.session import shared_folder
from tests.llm import test_decontaminate, test_neardup, test_substrings


def corpus(seed=3):
    rng = random.Random(seed)
    stems = ["the", "of", "and", "is", "river", "stone", "market", "garden", "evening", "letter", "winter", "harbour", "in", "to", "mountain"]
    sentence = lambda: " ".join(rng.choice(stems) + rng.choice(["", "", "s", "ly", "ing"]) for _ in range(9)).capitalize() + "."
    plain = lambda n: " ".join(sentence() for _ in range(n))
    texts = [plain(rng.randint(3, 12)) for _ in range(40)]
    texts += [t.replace("river", "lake", 1) for t in texts[:8]] + texts[8:12]
    shared = plain(3)
    texts += [plain(4) + "\n" + shared + "\n" + plain(4) for _ in range(6)]
    item = " ".join(f"question{i}" for i in range(14))
    texts += [plain(4) + " " + item + " " + plain(3), "too short", None, " ".join(w + "###" for w in plain(4).split()), plain(900)]
    return [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], item


def test_against_brute_force(spark):
    rows, item = corpus()
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    kept = {r["doc_id"] for r in judge_quality(docs).filter("kept").collect()}
    left = [(d, t) for d, t, *_ in rows if d in kept]
    assert len(left) < len(rows) - 2
    alone = {int(d) for d, _, _, keep in test_neardup.brute(left, 5, 80) if keep}
    assert len(alone) < len(left)
    left = [(d, t) for d, t in left if d in alone]
    cut = {int(d): raw.decode("utf-8", "ignore") for d, _, _, _, raw in test_substrings.brute(left, 50)}
    assert any(cut[d] != t for d, t in left)
    hits = {int(d): n for d, _, n, _ in test_decontaminate.brute(sorted(cut.items()), [(1, item)], 10)}
    assert any(hits.values())
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = []
    for d, text in cut.items():
        size = len(tokenizer.encode(text, add_special_tokens=False).ids) + 1
        if not hits[d]:
            expected += [(d, i, s, min(4096, size - s)) for i, s in enumerate(range(0, size, 4096))]

    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"]) for r in got) == sorted(expected)
    ends = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 4096
    assert len(ends) <= int(np.ceil(sum(e[3] for e in expected) / 4096)) + 1


def test_stages_return_documents_also_from_nothing(spark):
    rows, item = corpus()
    docs = spark.createDataFrame(rows[:0], "doc_id long, text string, lang string, source string, n_chars long")
    folder = f"{shared_folder(spark)}/nothing-{uuid.uuid4().hex}"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(os.path.join(folder, "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.schema.simpleString() == docs.schema.simpleString()
        assert out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == 0
