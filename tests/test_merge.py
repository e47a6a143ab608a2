"""Fragment merging: fixtures, brute force on random pages, and the same answers on pages cut into chunks."""

import random

import pytest
from pyspark.sql import functions as F

from marginalia.operators import merge
from marginalia.operators.merge import drop_shadowed, merge_fragments, merge_stroke_regions, whole_highlights
from marginalia.operators.spatial import reading_order

SCHEMA = "doc string, page int, seq bigint, text string, color string, x double, y double, w double, h double"


def frag(seq, text, x=None, y=None, w=50.0, page=1, color="yellow", h=14.0, doc="d"):
    return (doc, page, seq, text, color, x, y, None if x is None else w, None if x is None else h)


def gutters(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc string, page int, gutter_x double")


def merged_texts(spark, rows, gutter=None):
    g = gutters(spark, [("d", 1, gutter)] if gutter else [])
    out = reading_order(whole_highlights(spark.createDataFrame(rows, SCHEMA), g), g)
    return [r.text for r in out.orderBy("page", "rank").collect()]


CASES = {
    "same line": ([frag(0, "Each edge (s, a)", 72.0, 400.0, 110.0), frag(1, "stores a prior probability", 190.0, 400.0, 180.0)], 1),
    "wide gap": ([frag(0, "left", 72.0, 400.0, 80.0), frag(1, "right", 400.0, 400.0, 80.0)], 2),
    "two colours": ([frag(0, "aa", 72.0, 400.0), frag(1, "bb", 130.0, 400.0, color="pink")], 2),
    "wrap": ([frag(0, "line one", 72.0, 400.0, 400.0), frag(1, "and two", 72.0, 418.0, 200.0)], 1),
    "far lines": ([frag(0, "one", 72.0, 400.0), frag(1, "two", 72.0, 500.0)], 2),
    "wrap not at the left": ([frag(0, "aaa", 300.0, 400.0, 180.0), frag(1, "bbb", 200.0, 418.0, 180.0)], 2),
    "shadowed tail": ([frag(0, "MCTS may be viewed as self-play", 72.0, 400.0, 350.0), frag(1, "M", 72.0, 415.0, 10.0)], 1),
    "shadow too far": ([frag(0, "moves were viewed", 72.0, 200.0, 300.0), frag(1, "v", 400.0, 600.0, 10.0)], 2),
    "partial word": ([frag(0, "achieved lower error", 72.0, 400.0, 200.0), frag(1, "hiev", 80.0, 415.0, 25.0)], 1),
    "two pages": ([frag(0, "a1", 72.0, 400.0), frag(1, "b2", 72.0, 400.0, page=2)], 2),
    "null colour": ([frag(0, "aa", 72.0, 400.0, color=None), frag(1, "bb", 130.0, 400.0)], 2),
    "overlap on a line": ([frag(0, "aa", 72.0, 400.0, 80.0), frag(1, "bb", 100.0, 400.0)], 2),
}


@pytest.mark.parametrize("name", CASES)
def test_fixture(spark, name):
    rows, count = CASES[name]
    assert len(merged_texts(spark, rows)) == count
    assert merged_texts(spark, rows[::-1]) == merged_texts(spark, rows)


def test_columns_and_boxless(spark):
    rows = [frag(0, "right bottom", 330.0, 500.0), frag(1, "left top", 50.0, 100.0), frag(2, "right top", 330.0, 100.0), frag(3, "left bottom", 50.0, 500.0)]
    assert merged_texts(spark, rows, 306.0) == ["left top", "left bottom", "right top", "right bottom"]
    rows = [frag(0, "left first line", 50.0, 100.0, 200.0), frag(1, "left wrapped line", 50.0, 118.0, 200.0), frag(2, "right", 330.0, 100.0)]
    assert merged_texts(spark, rows, 306.0) == ["left first line left wrapped line", "right"]
    assert merged_texts(spark, [frag(0, "term", 260.0, 100.0, 40.0), frag(1, "the term", 330.0, 100.0)], 306.0) == ["term", "the term"]
    assert sorted(merged_texts(spark, [frag(0, "alpha"), frag(1, "beta"), frag(2, "gamma", 1.0, 1.0)])[:2]) == ["alpha", "beta"]


def brute_drop(rows, max_gap=100.0):
    def gap(a, b):
        dx = max(0.0, b[5] - (a[5] + a[7]), a[5] - (b[5] + b[7]))
        return dx + max(0.0, b[6] - (a[6] + a[8]), a[6] - (b[6] + b[8]))

    gone = set()
    for a in rows:
        for b in rows:
            if a[2] != b[2] and b[2] not in gone and len(a[3]) < len(b[3]) and a[3] in b[3] and gap(a, b) <= max_gap:
                gone.add(a[2])
                break
    return {r[2] for r in rows} - gone


def brute_merge(rows):
    runs, run, left = [], None, None
    for r in sorted(rows, key=lambda r: (r[6], r[5], r[2])):
        goes_on = False
        if run:
            last = run[-1]
            shared = max(0.0, min(last[6] + last[8], r[6] + r[8]) - max(last[6], r[6]))
            same = shared / max(1e-6, min(last[8], r[8])) >= 0.5
            along, below = r[5] - last[5] - last[7], r[6] - last[6] - last[8]
            goes_on = (same and 0 <= along < 30) or (not same and 0 < below <= (last[8] + r[8]) / 2 and abs(r[5] - left) < 20)
        if goes_on:
            run.append(r)
            left = min(left, r[5])
        else:
            run, left = [r], r[5]
            runs.append(run)
    return {r[0][2]: len(r) for r in runs}


def test_large_pages_match_brute_force(spark):
    rng = random.Random(1)
    words = ["a", "ab", "abc", "cab", "abcab", "bca", "xabcabx", "abcabcabc", "zz", "b"]
    rows = [
        frag(i, rng.choice(words), float(rng.randrange(0, 12) * 7), float(rng.randrange(0, 60) * 8), float(rng.randrange(5, 40)))
        for i in range(300)
    ]
    # Copies alike in all but their place in the order.
    rows += [(*rows[i][:2], 300 + k, *rows[i][3:]) for k, i in enumerate(rng.choices(range(300), k=100))]
    df, none = spark.createDataFrame(rows, SCHEMA), gutters(spark)
    kept = brute_drop(rows)
    for rows_a_bucket in (10_000, 150, 7):
        assert {r.seq for r in drop_shadowed(df, none, bucket_rows=rows_a_bucket).collect()} == kept
    runs = brute_merge(rows)
    small = merge_fragments(df, none, piece_rows=10_000)
    large = merge_fragments(df, none, piece_rows=150)
    assert {r.seq: r.fragments for r in small.collect()} == runs
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_shadows_in_chains(spark, seed):
    """Texts that hold one another in chains, holders before and after, some too far; whole pages and many buckets."""
    rng = random.Random(seed)
    base = "the quick brown fox jumps over the lazy dog é漢"
    rows = []
    for i in range(160):
        a = rng.randrange(len(base) - 1)
        text = base[a : a + rng.randrange(1, 2 + rng.randrange(1, len(base)))]
        rows.append(frag(i, text, float(rng.randrange(0, 500)), float(rng.randrange(0, 300)), float(rng.randrange(1, 60))))
    rows += [(*rows[i][:2], 160 + k, *rows[i][3:]) for k, i in enumerate(rng.choices(range(160), k=40))]
    rows += [frag(300, ""), frag(301, "", 5.0, 5.0), (*frag(302, "x", 9.0, 9.0)[:3], None, *frag(302, "x", 9.0, 9.0)[4:])]
    df, none = spark.createDataFrame(rows, SCHEMA), gutters(spark)
    kept = brute_drop([r for r in rows if r[3] and r[5] is not None]) | {300, 301, 302}
    for rows_a_bucket in (10_000, 60, 3):
        assert {r.seq for r in drop_shadowed(df, none, bucket_rows=rows_a_bucket).collect()} == kept


def test_alike_texts_write_a_row_each(spark):
    """500 texts each within all longer ones: what the search for holders hands on is a row per text."""
    rows = [frag(i, "ab" * 3 + "c" * i, float(i % 40), 10.0) for i in range(500)]
    df, none = spark.createDataFrame(rows, SCHEMA), gutters(spark)
    for rows_a_bucket in (10_000, 200):
        assert {r.seq for r in drop_shadowed(df, none, bucket_rows=rows_a_bucket).collect()} == {499}
    nodes = merge.with_side(df, none).withColumns({"bucket": F.lit(0), "buckets": F.array(F.lit(0)), "waits": F.lit(False)})
    assert merge._held(nodes, nodes, 100.0, holder=F.max("b_seq")).count() == 499


def test_long_drifting_run_across_pieces(spark):
    rows = [frag(i, f"t{i}", 72.0 + (i * 7) % 23 + (i // 40) * 3, 20.0 * i, 100.0) for i in range(300)]
    df, none = spark.createDataFrame(rows, SCHEMA), gutters(spark)
    assert {r.seq: r.fragments for r in merge_fragments(df, none, piece_rows=80).collect()} == brute_merge(rows)


@pytest.mark.parametrize("seed", range(4))
def test_pieces_of_any_size(spark, seed):
    """Pages where nearly every line may go on the one above, so that edges pass many pieces and tree levels."""
    rng = random.Random(seed)
    step = [0.001, 0.1, 3.0, 9.0][seed]
    rows, x = [], 72.0
    for i in range(240):
        x += rng.choice([-1, 1, 1]) * step * rng.random() if rng.random() < 0.9 else rng.choice([-30, 30])
        rows.append(frag(i, f"t{i}", x, 20.0 * (i // 2) + 0.01 * (i % 2), 12.0))
    df, none = spark.createDataFrame(rows, SCHEMA), gutters(spark)
    runs = brute_merge(rows)
    for piece_rows, fan in ((10_000, 64), (100, 64), (20, 2)):
        merged = merge_fragments(df, none, piece_rows=piece_rows, fan=fan).collect()
        assert {r.seq: r.fragments for r in merged} == runs


def test_no_python_on_pages_of_any_size(spark):
    df = spark.createDataFrame([frag(i, f"a{i % 5}", float(i % 7), 9.0 * i) for i in range(60)], SCHEMA)
    for rows in (10_000, 20):
        for result in (merge_fragments(df, gutters(spark), piece_rows=rows), drop_shadowed(df, gutters(spark), bucket_rows=rows)):
            plan = result._jdf.queryExecution().executedPlan().toString()
            assert "Python" not in plan and "Pandas" not in plan


def test_stroke_regions(spark):
    def strokes(*rows):
        rows = [("d", 1, i, c, 0.0, y - 10, 50.0, 20.0) for i, (y, c) in enumerate(rows)]
        return spark.createDataFrame(rows, "doc string, page int, stroke_id int, color string, x double, y double, w double, h double")

    def counts(*rows, **kw):
        return [r.stroke_count for r in merge_stroke_regions(strokes(*rows), **kw).orderBy("region").collect()]

    assert counts((100.0, "yellow"), (120.0, "yellow")) == [2]
    assert counts((100.0, "yellow"), (300.0, "yellow")) == [1, 1]
    assert counts((100.0, "yellow"), (120.0, "green")) == [1, 1]
    many = [(25.0 * i + (100 if i % 9 == 0 else 0), "yellow") for i in range(200)]
    assert counts(*many) == counts(*many, limit=30)


def test_fragments_are_numbered_once(spark):
    from marginalia.plans.bindings import Tables

    tables = Tables(spark, "/root/testdata/sf0.001")
    merged = merge_fragments(tables("fragments"), tables("fragment_gutters"))
    plan = merged._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan and "array_sort" not in plan
    assert merged.count() > 0


def test_pages_are_dealt_once_to_drop_what_is_shadowed(spark, monkeypatch):
    def kept_nothing(df):
        raise AssertionError("a table is written")

    monkeypatch.setattr(merge, "durable", kept_nothing)
    monkeypatch.setattr(merge, "written", kept_nothing)
    rows = [("d", p, i, ("word", "a word", "other")[i % 3], "yellow", 10.0 * i, 5.0, 60.0, 14.0) for p in range(3) for i in range(6)]
    df = spark.createDataFrame(rows, SCHEMA)
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        kept = drop_shadowed(df, gutters(spark))
        plan = kept._jdf.queryExecution().executedPlan().toString()
        found = {(r.page, r.seq) for r in kept.collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found == {(p, i) for p in range(3) for i in range(6) if i % 3}
    assert plan.count("Exchange hashpartitioning") - plan.count("ReusedExchange") == 2


def test_shadows_with_odd_keys(spark):
    box = (10.0, 5.0, 60.0, 14.0)
    rows = [
        ("d", 1, 0, "word", "c", *box), ("d", 1, 1, "a word", "c", *box), ("d", 1, 1, "a word", "c", *box),  # held by a row that comes twice
        ("d", 2, 5, "word", "c", *box), ("d", 2, 5, "a word", "c", *box),  # the holder has the same number
        ("d", 3, None, "a word", "c", *box), ("d", 3, 1, "word", "c", *box),  # the only holder has none
        (None, 4, 0, "word", "c", *box), (None, 4, 1, "a word", "c", *box), ("d", None, 0, "word", "c", *box), ("d", None, 1, "a word", "c", *box),
        ("d", 5, 0, "a word", "c", None, None, None, None), ("d", 5, 1, "word", "c", *box),  # a boxless one holds nothing
        ("d", 6, 0, "so a word", "c", *box), ("d", 6, 1, "a word", "c", *box), ("d", 6, 2, "word", "c", *box),  # held by an earlier one that stays
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    gone = [rows[i] for i in (0, 14, 15)]
    twice = spark.createDataFrame([("d", 6, 200.0), ("d", 6, 200.0), ("d", 1, 20.0), ("d", 1, 300.0)], "doc string, page int, gutter_x double")
    for lines in (gutters(spark), twice):
        assert sorted(map(tuple, drop_shadowed(df, lines).collect()), key=str) == sorted((r for r in rows if r not in gone), key=str)
