"""Text under boxes, gutters, strokes, coordinates."""

import random

import pytest
from pyspark.sql import functions as F

from marginalia.functions import geometry
from marginalia.operators import spatial, strokes

WORD = "doc string, page int, word_id int, word string, x0 double, y0 double, x1 double, y1 double"
RECT = "doc string, page int, hl_id string, rect_id int, x double, y double, w double, h double"
GUTTER = "doc string, page int, gutter_x double"
STROKE = "doc string, page int, stroke_id int, pen_type int, color string, width double"
POINT = "doc string, page int, stroke_id int, pt int, x double, y double, speed double, width double, pressure double, tilt double"


def under(spark, words, rects, gutter=None):
    w = spark.createDataFrame([("d", 1, i, *x) for i, x in enumerate(words)], WORD)
    r = spark.createDataFrame([("d", 1, h, i, *x) for i, (h, *x) in enumerate(rects)], RECT)
    g = spark.createDataFrame([("d", 1, gutter)] if gutter else [], GUTTER)
    return {x.hl_id: x.text for x in spatial.text_under_rects(r, w, g).collect()}


def test_line(spark):
    words = [(w, 72.0 + 32 * i, 100.0, 100.0 + 32 * i, 114.0) for i, w in enumerate("one two three four five".split())] + [("Other", 72.0, 140.0, 110.0, 154.0)]
    assert under(spark, words, [("h", 70.0, 98.0, 162.0, 18.0)]) == {"h": "one two three four five"}
    assert under(spark, words, [("h", 70.0, 98.0, 162.0, 18.0), ("h", 70.0, 99.0, 50.0, 5.0)]) == {"h": "one two three four five"}
    assert under(spark, words, [("far", 400.0, 700.0, 10.0, 10.0), ("touch", 0.0, 114.0, 600.0, 26.0)]) == {"far": "", "touch": ""}
    flat = [("h", 70.0, 98.0, 0.0, 18.0), ("h", 70.0, 98.0, 50.0, 18.0), ("only flat", 70.0, 98.0, 50.0, 0.0), ("wide", 0.0, 0.0, 5000.0, 5000.0)]
    assert under(spark, words, flat) == {"h": "one two", "only flat": "", "wide": "one two three four five Other"}


def test_boxes_are_read_once(spark):
    words, rects = spark.createDataFrame([], WORD), spark.createDataFrame([("d", 1, "h", 0, None, 1.0, 2.0, 3.0)], RECT)
    found = spatial.text_under_rects(rects.repartition(3, "hl_id"), words, spark.createDataFrame([], GUTTER))
    assert [tuple(r) for r in found.collect()] == [("d", 1, "h", "")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 1


def test_boxes_on_the_canvas(spark):
    """Grown by half the pen, cut at the page, scaled down where the page's strokes reach far below the screen."""
    drawn = [("d", 1, 1, 5, "yellow", 1.0), ("d", 1, 2, 18, "pink", 20.0), ("d", 1, 3, 4, "black", 1.0), ("d", 2, 4, 5, "yellow", 1.0), ("d", 2, 5, 5, "yellow", 1.0)]
    corners = [(1, 1, -702.0, 0.0), (1, 1, 0.0, 18.72), (1, 2, 0.0, 93.6), (1, 2, 140.4, 93.6), (1, 3, 0.0, 5.0), (2, 4, 0.0, 2400.0), (2, 4, 300.0, 2400.0), (2, 5, 5000.0, 0.0)]
    points = [("d", page, stroke, i, x, y, 1.0, 1.0, 1.0, 0.0) for i, (page, stroke, x, y) in enumerate(corners)]
    sizes = spark.createDataFrame([("d", 1, 612.0, 792.0), ("d", 2, 612.0, 792.0)], "doc string, page int, page_w double, page_h double")
    found = spatial.canvas_rects(spark.createDataFrame(drawn, STROKE), spark.createDataFrame(points, POINT), sizes)
    got = {r.hl_id: [round(v, 3) for v in (r.x, r.y, r.w, r.h)] for r in found.collect()}
    point, fine = 612 / 1404, 226 / 300
    assert got == {
        1: [0.0, 0.0, round((702 + 4) * point, 3), round((18.72 + 4) * point, 3)],
        2: [round((702 - 10) * point, 3), round((93.6 - 10) * point, 3), round((140.4 + 20) * point, 3), round(20 * point, 3)],
        4: [round((702 - 4) * point, 3), round((2400 * fine - 4) * point, 3), round((300 * fine + 8) * point, 3), round(min(792, (2400 * fine + 4) * point) - (2400 * fine - 4) * point, 3)],
    }


def test_columns(spark):
    words = [("right-top", 330.0, 100.0, 400.0, 112.0), ("left-bottom", 50.0, 200.0, 120.0, 212.0), ("left-top", 50.0, 100.0, 120.0, 112.0), ("right-bottom", 330.0, 200.0, 400.0, 212.0)]
    assert under(spark, words, [("h", 0.0, 0.0, 612.0, 792.0)], 306.0) == {"h": "left-top left-bottom right-top right-bottom"}
    assert under(spark, words, [("h", 0.0, 0.0, 612.0, 792.0)]) == {"h": "left-top right-top left-bottom right-bottom"}


def test_against_brute_force(spark):
    rng = random.Random(3)
    words = [(f"w{i}", x, y, x + rng.uniform(1, 300), y + rng.uniform(1, 90)) for i in range(200) for x, y in [(rng.uniform(-50, 600), rng.uniform(-50, 780))]]
    rects = [(f"h{i % 20}", rng.uniform(-50, 600), rng.uniform(-50, 780), rng.uniform(-5, 400), rng.uniform(1, 300)) for i in range(40)]
    expected = {}
    for h, x, y, w, hh in rects:
        hits = expected.setdefault(h, set())
        hits.update(wd for wd in words if wd[1] < x + w and wd[3] > x and wd[2] < y + hh and wd[4] > y and w > 0)
    texts = {h: " ".join(wd[0] for wd in sorted(hits, key=lambda wd: (wd[2], wd[1]))) for h, hits in expected.items()}
    assert under(spark, words, rects) == texts


def test_gutters(spark):
    schema = "doc string, page int, block_id int, text string, x0 double, x1 double, page_width double"
    rows = [
        ("two", 1, 0, "l" * 60, 40.0, 280.0, 612.0),
        ("two", 1, 1, "r" * 60, 332.0, 570.0, 612.0),
        ("two", 1, 2, "title", 100.0, 500.0, 612.0),
        ("one", 1, 0, "w" * 200, 40.0, 570.0, 612.0),
        ("one", 1, 1, "foot", 300.0, 320.0, 612.0),
        ("thin", 1, 0, "l" * 49 + "   ", 40.0, 280.0, 612.0),
        ("thin", 1, 1, "r" * 60, 332.0, 570.0, 612.0),
    ]
    found = spatial.detect_gutters(spark.createDataFrame(rows, schema)).collect()
    assert [(r.doc, r.gutter_x) for r in found] == [("two", 306.0)]


def test_coordinates(spark):
    c = F.lit
    box = geometry.centred_to_page(c(-243.0), c(437.0), c(100.0), c(35.0), c(612.0), c(792.0))
    origin = geometry.centred_to_page(c(0.0), c(0.0), c(0.0), c(0.0), c(612.0), c(792.0))
    old = geometry.screen_to_page(c(702.0), c(936.0), c(1404.0), c(0.0), c(612.0), c(792.0))
    pad = geometry.padded_on_page({"x": c(-5.0), "y": c(1.0), "w": c(900.0), "h": c(10.0)}, c(612.0), c(792.0))
    row = spark.range(1).select(box["y"], origin["x"], origin["y"], old["x"], old["y"], old["w"], *[pad[k] for k in "xywh"]).first()
    assert abs(row[0] - 139.3) < 2 and row[1:3] == (306.0, 0.0)
    assert row[3:6] == (306.0, 396.0, 612.0) and row[6:] == (0.0, 0.0, 612.0, 16.0)


def points(spark, per_stroke, page=1):
    rows = [("d", page, s, i, *p) for s, ps in per_stroke.items() for i, p in enumerate(ps)]
    return spark.createDataFrame([(d, pg, s, i, float(x), float(y), 1.0, float(w), 0.5, float(t)) for d, pg, s, i, x, y, w, t in rows], POINT)


def pens(spark, kinds, width=1.0):
    return spark.createDataFrame([("d", 1, s, k, "yellow", width) for s, k in kinds.items()], STROKE)


def test_highlighter_strokes(spark):
    line = [(0, 0, 1, 0), (100, 1, 1, 0)]
    tap = [(5, 5, 1, 0), (7, 8, 1, 0)]
    kept = strokes.drop_accidental_strokes(pens(spark, {1: 18, 2: 5, 3: 1, 4: 17, 5: 18, 6: 18}), points(spark, {1: line, 2: line, 3: line, 4: line, 5: tap, 6: line}))
    assert {r.stroke_id for r in kept.collect()} == {1, 2, 6}


def test_padded_boxes(spark):
    one = strokes.padded_stroke_boxes(pens(spark, {1: 5}, 10.0), points(spark, {1: [(100, 200, 1, 0)]})).first()
    assert (one.x, one.y, one.w, one.h) == (95.0, 195.0, 10.0, 10.0)
    corner = strokes.padded_stroke_boxes(pens(spark, {1: 5}, 50.0), points(spark, {1: [(1, 1, 1, 0)]})).first()
    assert corner.x >= 0 and corner.y >= 0 and corner.w == 50.0


@pytest.mark.parametrize("ys, crop, low, high", [((100, 300), True, 300, 340), ((100, 300), False, 1872, 1872), ((100, 1700), True, 1872, 1872), ((20, 50), True, 240, 240), ((100, 1900), True, 1908, 1908)])
def test_page_height(spark, ys, crop, low, high):
    none = spark.createDataFrame([], RECT)
    extent = strokes.page_extent(pens(spark, {1: 1}), points(spark, {1: [(0, y, 1, 0) for y in ys]}), none, truncate=crop).first()
    assert low <= extent.height <= high and extent.width == 1404


def test_page_shift(spark):
    rect = spark.createDataFrame([("d", 1, "h", 0, -800.0, 10.0, 1600.0, 5.0)], RECT)
    extent = strokes.page_extent(pens(spark, {1: 1, 2: 6}), points(spark, {1: [(0, -3, 1, 0)], 2: [(-5000, 9000, 1, 0)]}), rect).first()
    assert (extent.shift_x, extent.shift_y) == (106.0, 11.0) and extent.width == 800 + 702 + 106 + 8
    drawn = points(spark, {1: [(-60, -40, 1, 0), (1000, 0, 1, 0)], 2: [(-70, -90, 1, 0)]})
    shift = strokes.canvas_shift(pens(spark, {1: 1, 2: 8}), drawn).first()
    assert (shift.shift_x, shift.shift_y) == (60.0, 0.0)
    erased = strokes.canvas_shift(pens(spark, {1: 6, 2: 8}), drawn).first()
    assert (erased.shift_x, erased.shift_y) == (0.0, 0.0)


def test_redirects(spark):
    schema = "source_id string, uuid string, page_idx int, page_id string, pdf_idx int"
    pages = spark.createDataFrame([("s", "a", 0, "p0", 3), ("s", "a", 1, "p1", None), ("s", "a", 2, "p2", 3), ("s", "b", 0, "q0", None)], schema)
    mapped = {(r.uuid, r.page_idx): r.source_idx for r in strokes.map_pages_to_source(pages).collect()}
    assert mapped == {("a", 0): 3, ("a", 1): None, ("a", 2): 3, ("b", 0): 0}
    drawn = spark.createDataFrame([("s", "a", 0), ("s", "a", 0), ("s", "a", 1), ("s", "a", 2), ("s", "b", 0)], "source_id string, uuid string, page_idx int")
    counts = strokes.page_stroke_counts(drawn, pages)
    assert {(r.uuid, r.page): r.strokes for r in counts.collect()} == {("a", 4): 3, ("b", 1): 1}
    assert {r.uuid: r.pages for r in strokes.stroked_page_list(counts).collect()} == {"a": [4], "b": [1]}


def moving(values, half):
    return [sum(values[max(0, i - half) : i + half + 1]) / len(values[max(0, i - half) : i + half + 1]) for i in range(len(values))]


@pytest.mark.parametrize("limit", [1000, 40])
def test_tilts(spark, limit):
    rng = random.Random(5)
    tilts = [0, 0, 5] + [rng.randrange(0, 60) for _ in range(100)] + [40, 0, 0]
    first = next(t for t in tilts if t > 10)
    head = tilts.index(first)
    filled = [first] * head + tilts[head:-2] + [40, 40]
    df = points(spark, {1: [(0, 0, 1, t) for t in tilts], 2: [(0, 0, 1, 3), (0, 0, 1, 50)], 3: [(0, 0, 1, 2)] * 4})
    found = {}
    for r in strokes.smooth_tilts(df, limit).orderBy("stroke_id", "pt").collect():
        found.setdefault(r.stroke_id, []).append(r.smooth_tilt)
    assert found[1] == pytest.approx(moving(filled, 4))
    assert found[2] == [3.0, 50.0] and found[3] == [2.0] * 4


def test_widths(spark):
    df = points(spark, {1: [(0, 0, 40, 0)] * 3 + [(0, 0, 80, 0)], 2: [(0, 0, 40, 0)] * 2, 3: [(0, 0, 40, 255)] * 3})
    found = {}
    for r in strokes.smooth_widths(pens(spark, {1: 2, 2: 18, 3: 1}, 1.0), df).orderBy("stroke_id", "pt").collect():
        found.setdefault(r.stroke_id, []).append(r.smooth_width)
    assert found[1] == pytest.approx(moving([1.2, 1.2, 1.2, 2.4], 2))
    assert found[2] == [8.0, 8.0]
    assert found[3] == pytest.approx([2 * 1.21 * 1.01 * 2.54] * 3)
    stats = {r.stroke_id: r.drawn_width for r in strokes.stroke_stats(pens(spark, {1: 2, 2: 18, 4: 3}, 1.0), df).collect()}
    assert stats == {1: 2.5, 2: 8.0, 4: 1.0}


def test_words_are_dealt_once(spark):
    rects = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 50.0, 10.0)], "doc bigint, page int, hl_id bigint, x double, y double, w double, h double")
    words = spark.createDataFrame([(1, 1, 1, "a", 0.0, 0.0, 9.0, 9.0), (1, 1, 2, "b", 20.0, 0.0, 29.0, 9.0)], "doc bigint, page int, word_id bigint, word string, x0 double, y0 double, x1 double, y1 double")
    found = spatial.text_under_rects(rects, words, spark.createDataFrame([(1, 1, 15.0)], GUTTER))
    assert found.first().text == "a b"
    lines = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    joined = next(i for i, line in enumerate(lines) if "Join LeftOuter" in line and "cx#" not in line)
    assert "hl_id" in next(line for line in lines[joined:] if "LogicalRDD" in line)


def test_words_are_dealt_once_by_page(spark):
    words = spark.createDataFrame([("d", p, i, f"w{i}", 20.0 * i, 10.0, 20.0 * i + 15, 22.0) for p in range(3) for i in range(6)], WORD)
    rects = spark.createDataFrame([("d", p, f"h{h}", 0, 40.0 * h, 12.0, 50.0, 5.0) for p in range(3) for h in range(2)], RECT)
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        found = spatial.text_under_rects(rects, words, spark.createDataFrame([], GUTTER))
        plan = found._jdf.queryExecution().executedPlan().toString()
        texts = {(r.page, r.hl_id): r.text for r in found.collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert plan.count("Exchange hashpartitioning") == 3  # words, boxes, gutters
    assert texts == {(p, h): t for p in range(3) for h, t in (("h0", "w0 w1 w2"), ("h1", "w2 w3 w4"))}


@pytest.mark.parametrize("page_words", [0, 60, 5_000])
def test_text_on_pages_of_any_size(spark, page_words):
    """Pages below and above the limit, boxes off any word, without an area, without a place or a page, repeated rows and gutters."""
    rng = random.Random(3)
    words = [("d", 1 + i % 3 // 2, i, f"w{i}", x := rng.uniform(-50, 2500), y := rng.uniform(-50, 900), x + rng.uniform(0, 90), y + rng.uniform(0, 30)) for i in range(150)]
    words += words[:5] + [("d", 1, None, "none", 0.0, 0.0, 900.0, 900.0), ("d", 1, 900, None, 0.0, 0.0, 900.0, 900.0), ("d", None, 901, "x", 0.0, 0.0, 9.0, 9.0), ("d", 1, 902, "flat", 0.0, 0.0, 900.0, 0.0)]
    rects = [("d", 1 + i % 2, f"h{i % 20}", i, rng.uniform(-50, 2000), rng.uniform(-50, 800), rng.uniform(-20, 900), rng.uniform(-5, 300)) for i in range(40)]
    rects += rects[:3] + [("d", None, "p", 0, 0.0, 0.0, 9.0, 9.0), ("d", 1, "x", 0, None, 0.0, 900.0, 900.0), ("d", 2, "y", 0, 0.0, None, 900.0, 900.0), ("d", 7, "z", 0, 0.0, 0.0, 9.0, 9.0)]
    gutters = [("d", 1, 700.0), ("d", 1, 700.0)]
    expected = {}
    for d, p, h, _, x, y, w, height in rects:
        hits = expected.setdefault((d, p, h), set())
        for _, page, i, text, x0, y0, x1, y1 in words:
            if p is not None and None not in (x, y, i) and page == p and w > 0 and height > 0 and x1 > x0 and y1 > y0 and max(x, x0) < min(x + w, x1) and max(y, y0) < min(y + height, y1):
                hits.add((int(p == 1 and x0 + (x1 - x0) / 2 >= 700.0), y0, x0, i, text))
    expected = {k: " ".join(t for *_, t in sorted(v, key=lambda r: r[:4]) if t is not None).strip() for k, v in expected.items()}
    tables = spark.createDataFrame(rects, RECT), spark.createDataFrame(words, WORD), spark.createDataFrame(gutters, GUTTER)
    found = spatial.text_under_rects(*tables, page_words).collect()
    assert {(r.doc, r.page, r.hl_id): r.text for r in found} == expected and len(found) == len(expected)
