import random
import re

from marginalia.llm.licenses import TEMPLATES, Template, scan_licenses
from tests.llm.rows import awkward, documents


def found(df):
    return {(str(r["doc_id"]), r["license_id"]): (r["n_found"], r["n_shingles"], r["containment"]) for r in df.collect()}


def test_every_template_in_prose_and_alone(spark):
    filler = " ".join(f"word{i}" for i in range(400))
    rows = []
    for i, t in enumerate(TEMPLATES):
        rows += [(10 * i, f"{filler}\n{t.text}\n{filler}"), (10 * i + 1, t.text.upper()), (10 * i + 2, filler + " " + t.text.replace(" ", "  "))]
    got = found(scan_licenses(documents(spark, rows + awkward())))
    for i, t in enumerate(TEMPLATES):
        for k in range(3):
            assert got[(str(10 * i + k), t.license_id)] == (t.shingles, t.shingles, 1.0)
    assert len(got) == 3 * len(TEMPLATES)


def test_containment_at_the_threshold(spark):
    text = " ".join(f"t{i}" for i in range(34))  # 30 shingles
    words = text.split()
    near, far = " ".join(words[:28]), " ".join(words[:27])
    middle = " ".join([*words[:16], "other", *words[17:]])  # five shingles lost
    template = (Template("own", text),)
    docs = documents(spark, [(1, "lead " + near), (2, far), (3, middle), (4, " ".join(words[16:])), (None, text)])
    assert found(scan_licenses(docs, template)) == {("1", "own"): (24, 30, 0.8), ("3", "own"): (25, 30, 25 / 30), ("None", "own"): (30, 30, 1.0)}


def test_gate_meets_every_shingle():
    for t in TEMPLATES:
        words = t.words
        for i in range(max(1, len(words) - 4)):
            assert set(words[i : i + 5]) & set(t.gate)


def test_empty_and_native(spark):
    assert scan_licenses(documents(spark, [])).count() == 0
    plan = scan_licenses(documents(spark, [(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


STANDARD_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
    'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
    "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
    "is furnished to do so, subject to the following conditions:"
)


def test_inserted_words_at_every_offset(spark):
    notice = (next(t for t in TEMPLATES if t.license_id == "MIT-notice" and t.shingles == 23),)
    rows = [(i, " ".join(f"w{k}" for k in range(i)) + " " + STANDARD_MIT) for i in range(40)]
    assert found(scan_licenses(documents(spark, rows), notice)) == {(str(i), "MIT-notice"): (19, 23, 19 / 23) for i in range(40)}


def test_every_start_by_brute_force(spark):
    rng = random.Random(4)
    template = Template("own", " ".join(f"t{i % 19}" for i in range(24)))
    known, (length, _) = template.distinct, template.window
    rows, expected = [], {}
    for doc in range(200):
        words = [f"w{i}" for i in range(rng.randrange(30))]
        for _ in range(rng.choice([1, 1, 2])):
            for w in template.words:
                words += [f"x{rng.randrange(9)}"] * (rng.random() < 0.03) + [w] * (rng.random() > 0.03)
        text = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        counts = [len(known & set(text[i : i + length])) for i in range(len(text))]
        rows.append((doc, " ".join(words)))
        if counts and 100 * max(counts) >= 80 * len(known):
            expected[doc] = (max(counts), next(i for i, n in enumerate(counts) if 100 * n >= 80 * len(known)))
    got = scan_licenses(documents(spark, rows + rows[:50]), (template,)).collect()
    assert {r["doc_id"]: (r["n_found"], r["first_word"]) for r in got} == expected
    assert 20 < len(expected) < 180


def test_no_match_without_an_anchor():
    for t in TEMPLATES:
        without = sum(not set(s) & set(t.anchors) for s in t.distinct)
        assert 100 * without < 80 * t.shingles


def test_bands_miss_no_match_that_counts():
    assert max(t.miss for t in TEMPLATES if t.words) < 1e-6
    for t in TEMPLATES:
        assert t.window[0] <= t.span


def test_plan_retrieves_by_minhash(spark):
    """Band values meet in a join, and nothing leaves the JVM, also in what is written on the way."""
    plan = scan_licenses(documents(spark, [(1, STANDARD_MIT)]))._jdf.queryExecution().executedPlan().toString()
    assert "band#" in plan and "value#" in plan and "Python" not in plan and "Arrow" not in plan


def test_long_text_of_many_matches(spark):
    """One text with a notice again and again, and others around it: the first place and the fullest window are found."""
    mit = next(t for t in TEMPLATES if t.license_id == "MIT-notice" and t.shingles == 23)
    filler = " ".join(f"word{i}" for i in range(97))
    text = " ".join([filler, "of this software and associated documentation files", filler] + [STANDARD_MIT, filler] * 60 + [mit.text, filler] * 20)
    got = scan_licenses(documents(spark, [(1, text)]), (mit,)).collect()
    words = re.findall("[a-z0-9]+", text.lower())
    shingles = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = [len(mit.distinct & set(shingles[i : i + mit.window[0]])) for i in range(len(shingles))]
    first = next(i for i, n in enumerate(counts) if 100 * n >= 80 * 23)
    assert [(r["n_found"], r["first_word"]) for r in got] == [(max(counts), first)] and max(counts) == 23


def test_usual_wordings_and_whole_texts(spark):
    gpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    wordings = {
        "Licensed under the MIT License": "MIT",
        "SPDX-License-Identifier: MIT OR Apache-2.0": "MIT",
        "// SPDX-License-Identifier: GPL-2.0-only": "GPL-2.0",
        "SPDX-License-Identifier: BSD-3-Clause": "BSD-3-Clause",
        "This text is licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0",
        "see https://creativecommons.org/licenses/by/4.0/": "CC-BY-4.0",
        "subject to the terms of the Mozilla Public License, v. 2.0.": "MPL-2.0",
        "Released under the ISC license.": "ISC",
        gpl: "GPL-3.0",
        gpl.replace("General", "Lesser General"): "LGPL-3.0",
        gpl.replace("version 3", "version 2"): "GPL-2.0",
    }
    rows = list(enumerate(wordings)) + [(100 + i, "some words " + t.text) for i, t in enumerate(TEMPLATES) if t.shingles > 60]
    got = found(scan_licenses(documents(spark, rows)))
    for i, license_id in enumerate(wordings.values()):
        assert (str(i), license_id) in got
    assert not {("9", "GPL-3.0"), ("10", "GPL-3.0")} & set(got)
    whole = {license_id for (doc, license_id) in got if int(doc) >= 100}
    assert whole >= {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "MIT-notice", "BSD-notice", "ISC", "CC0-1.0"}


def test_texts_of_one_license_are_told_apart():
    sizes = [(t.license_id, t.shingles) for t in TEMPLATES if t.shingles > 1]
    assert len(sizes) == len(set(sizes))
