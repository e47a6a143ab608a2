"""Queries over pages: words, boxes, fragments, strokes."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.functions import geometry
from marginalia.operators import merge, notes, spatial, strokes
from marginalia.plans.registry import query, trimmed_sql

def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


# --- merging ---------------------------------------------------------------------------------------------------------

SHADOW = """
boxed AS MATERIALIZED (SELECT f.*, CASE WHEN g.gutter_x IS NULL OR x + w / 2.0 < g.gutter_x THEN 0 ELSE 1 END AS side
    FROM fragments f LEFT JOIN fragment_gutters g USING (doc, page) WHERE x IS NOT NULL),
edges AS (SELECT a.doc, a.page, a.seq, b.seq AS held_by FROM boxed a JOIN boxed b ON a.doc = b.doc AND a.page = b.page AND a.side = b.side
    AND length(a.text) >= 1 AND length(a.text) < length(b.text) AND contains(b.text, a.text)
    AND greatest(0, b.x - (a.x + a.w), a.x - (b.x + b.w)) + greatest(0, b.y - (a.y + a.h), a.y - (b.y + b.h)) <= 100),
held AS (SELECT doc, page, seq, max(held_by) > seq AS later, coalesce(list(held_by) FILTER (held_by < seq), []) AS earlier,
    row_number() OVER (PARTITION BY doc, page ORDER BY seq) AS k FROM edges GROUP BY doc, page, seq),
gone(doc, page, k, seqs) AS (SELECT doc, page, CAST(0 AS BIGINT), CAST([] AS BIGINT[]) FROM (SELECT DISTINCT doc, page FROM held)
    UNION ALL SELECT g.doc, g.page, h.k, CASE WHEN h.later OR len(list_filter(h.earlier, lambda e: NOT list_contains(g.seqs, e))) > 0
        THEN list_append(g.seqs, h.seq) ELSE g.seqs END
    FROM gone g JOIN held h ON g.doc = h.doc AND g.page = h.page AND h.k = g.k + 1),
last_gone AS (SELECT doc, page, arg_max(seqs, k) AS seqs FROM gone GROUP BY doc, page),
kept AS MATERIALIZED (SELECT f.* FROM fragments f LEFT JOIN last_gone g USING (doc, page) WHERE NOT coalesce(list_contains(g.seqs, f.seq), FALSE))"""

# One row per fragment in reading order, carrying the run it belongs to.
RUNS = """
lined AS MATERIALIZED (SELECT f.*, row_number() OVER (PARTITION BY f.doc, f.page, f.color ORDER BY
        CASE WHEN g.gutter_x IS NULL OR x + w / 2.0 < g.gutter_x THEN 0 ELSE 1 END, y, x, seq) AS k
    FROM {source} f LEFT JOIN fragment_gutters g USING (doc, page) WHERE x IS NOT NULL),
flagged AS MATERIALIZED (SELECT l.doc, l.page, l.color, l.k, l.seq, l.text, l.x AS fx, l.y AS fy, l.x + l.w AS fr, l.y + l.h AS fb,
        greatest(0, least(p.y + p.h, l.y + l.h) - greatest(p.y, l.y)) / greatest(1e-6, least(p.h, l.h)) >= 0.5 AS same_line,
        l.x - (p.x + p.w) AS along, l.y - (p.y + p.h) AS below, (p.h + l.h) / 2.0 AS mean_h
    FROM lined l LEFT JOIN lined p ON l.doc = p.doc AND l.page = p.page AND l.color = p.color AND l.k = p.k + 1),
run(doc, page, color, k, first, body, x, y, r, b, n) AS (
    SELECT doc, page, color, k, seq, text, fx, fy, fr, fb, 1 FROM flagged WHERE k = 1
    UNION ALL SELECT doc, page, color, nk, CASE WHEN j THEN first ELSE seq END,
        CASE WHEN NOT j THEN text WHEN body = '' THEN text WHEN text = '' THEN body
            WHEN suffix(body, ' ') OR prefix(text, ' ') THEN replace(body || text, '  ', ' ') ELSE body || ' ' || text END,
        CASE WHEN j THEN least(x, fx) ELSE fx END, CASE WHEN j THEN least(y, fy) ELSE fy END,
        CASE WHEN j THEN greatest(r, fr) ELSE fr END, CASE WHEN j THEN greatest(b, fb) ELSE fb END, CASE WHEN j THEN n + 1 ELSE 1 END
    FROM (SELECT run.*, f.k AS nk, f.seq, f.text, f.fx, f.fy, f.fr, f.fb,
            (same_line AND along >= 0 AND along < 30) OR (NOT same_line AND below > 0 AND below <= mean_h AND abs(f.fx - run.x) < 20) AS j
        FROM run JOIN flagged f ON f.doc = run.doc AND f.page = run.page AND f.color = run.color AND f.k = run.k + 1) z),
merged AS (SELECT doc, page, color, first AS seq, arg_max(body, k) AS text, arg_max(x, k) AS x, arg_max(y, k) AS y, arg_max(r, k) - arg_max(x, k) AS w,
        arg_max(b, k) - arg_max(y, k) AS h, CAST(max(n) AS INTEGER) AS fragments FROM run GROUP BY doc, page, color, first
    UNION ALL SELECT doc, page, color, seq, text, x, y, w, h, 1 FROM {source} WHERE x IS NULL)"""
RUN_ROWS = "SELECT doc, page, color, seq, text, round(x, 6) AS x, round(y, 6) AS y, round(w, 6) AS w, round(h, 6) AS h, fragments FROM merged"


@query("drop_shadowed", "fragments fragment_gutters", SHADOW, "SELECT doc, page, seq, text FROM kept")
def drop_shadowed(t):
    return merge.drop_shadowed(t("fragments"), t("fragment_gutters")).select("doc", "page", "seq", "text")


@query("merge_fragments", "fragments fragment_gutters", RUNS.format(source="fragments"), RUN_ROWS)
def merge_fragments(t):
    return rounded(merge.merge_fragments(t("fragments"), t("fragment_gutters")), "x", "y", "w", "h")


@query("whole_highlights", "fragments fragment_gutters", SHADOW + "," + RUNS.format(source="kept"), RUN_ROWS)
def whole_highlights(t):
    return rounded(merge.whole_highlights(t("fragments"), t("fragment_gutters")), "x", "y", "w", "h")


@query(
    "reading_order",
    "fragments fragment_gutters",
    "",
    """SELECT doc, page, seq, row_number() OVER (PARTITION BY doc, page ORDER BY CASE WHEN gutter_x IS NULL OR x IS NOT NULL AND x + w / 2.0 < gutter_x THEN 0 ELSE 1 END,
        y NULLS FIRST, x NULLS FIRST, seq) AS rank FROM fragments LEFT JOIN fragment_gutters USING (doc, page)""",
)
def reading_order(t):
    return spatial.reading_order(t("fragments"), t("fragment_gutters")).select("doc", "page", "seq", "rank")


@query(
    "merge_stroke_regions",
    "strokes stroke_points",
    """s AS (SELECT doc, page, stroke_id, color, greatest(0, min(p.x) - width / 2) AS x, greatest(0, min(p.y) - width / 2) AS y,
        max(p.x) - min(p.x) + width AS w, max(p.y) - min(p.y) + width AS h
        FROM (SELECT doc, page, stroke_id, color, width FROM strokes) s JOIN (SELECT stroke_id, x, y FROM stroke_points) p USING (stroke_id)
        GROUP BY doc, page, stroke_id, color, width),
    l AS (SELECT *, lag(y + h) OVER o AS bottom, lag(color) OVER o AS above FROM s WINDOW o AS (PARTITION BY doc, page ORDER BY y, stroke_id)),
    r AS (SELECT *, CAST(sum(CASE WHEN bottom IS NULL OR y - bottom > 40 OR color <> above THEN 1 ELSE 0 END)
        OVER (PARTITION BY doc, page ORDER BY y, stroke_id) AS BIGINT) AS region FROM l)""",
    """SELECT doc, page, region, any_value(color) AS color, round(min(x), 6) AS x, round(min(y), 6) AS y, round(max(x + w) - min(x), 6) AS w,
        round(max(y + h) - min(y), 6) AS h, count(*) AS stroke_count FROM r GROUP BY doc, page, region""",
)
def merge_stroke_regions(t):
    boxes = strokes.padded_stroke_boxes(t("strokes"), t("stroke_points"))
    return rounded(merge.merge_stroke_regions(boxes, sizes=t("strokes")), "x", "y", "w", "h")


@query(
    "merge_highlight_sources",
    "page_highlights",
    "",
    "SELECT CAST(doc AS VARCHAR) || ':' || CAST(seq AS VARCHAR) AS id, text FROM page_highlights",
)
def merge_highlight_sources(t):
    named = t("page_highlights").select("color", F.concat(F.col("doc").cast("string"), F.lit(":"), F.col("seq").cast("string")).alias("id"), "text")
    drawn = named.filter(F.col("color") == "pink")
    return merge.merge_highlight_sources(named.drop("color"), drawn.drop("color"))


# --- text under boxes ------------------------------------------------------------------------------------------------


@query(
    "text_under_rects",
    "words rects page_gutters",
    """hit AS (SELECT DISTINCT r.doc, r.page, r.hl_id, w.word_id, w.word, w.y0, w.x0, CASE WHEN g.gutter_x IS NULL OR (w.x0 + w.x1) / 2.0 < g.gutter_x THEN 0 ELSE 1 END AS side
        FROM rects r JOIN words w ON r.doc = w.doc AND r.page = w.page AND greatest(r.x, w.x0) < least(r.x + r.w, w.x1) AND greatest(r.y, w.y0) < least(r.y + r.h, w.y1)
        LEFT JOIN page_gutters g ON g.doc = r.doc AND g.page = r.page),
    found AS (SELECT doc, page, hl_id, trim(string_agg(word, ' ' ORDER BY side, y0, x0, word_id)) AS text FROM hit GROUP BY doc, page, hl_id)""",
    """SELECT r.doc, r.page, r.hl_id, coalesce(f.text, '') AS text FROM (SELECT DISTINCT doc, page, hl_id FROM rects) r LEFT JOIN found f USING (doc, page, hl_id)""",
)
def text_under_rects(t):
    return spatial.text_under_rects(t("rects"), t("words"), t("page_gutters"))


@query(
    "detect_gutters",
    "blocks",
    f"""b AS (SELECT doc, page, page_width / 2 AS g, x0, x1, length({trimmed_sql('text')}) AS n FROM blocks),
    s AS (SELECT doc, page, max(g) AS gutter_x, coalesce(sum(n) FILTER (x1 <= g), 0) AS l, coalesce(sum(n) FILTER (x1 > g AND x0 >= g), 0) AS r, sum(n) AS a FROM b GROUP BY doc, page)""",
    "SELECT doc, page, gutter_x FROM s WHERE l >= 50 AND r >= 50 AND (a - l - r) / a <= 0.30",
)
def detect_gutters(t):
    return spatial.detect_gutters(t("blocks"))


@query(
    "union_boxes",
    "rects",
    "",
    "SELECT doc, page, hl_id, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM rects GROUP BY doc, page, hl_id",
)
def union_boxes(t):
    return spatial.union_boxes(t("rects"))


@query(
    "highlighter_rects",
    "strokes stroke_points",
    """b AS (SELECT doc, page, stroke_id, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM stroke_points GROUP BY doc, page, stroke_id),
    k AS (SELECT b.* FROM b JOIN strokes s USING (doc, page, stroke_id) WHERE pen_type IN (5, 18) AND (x1 - x0 >= 5 OR y1 - y0 >= 5)),
    c AS (SELECT *, 612.0 / (1404 * (300.0 / 226)) AS sx, 792.0 / (1872 * (300.0 / 226)) AS sy FROM k),
    p AS (SELECT *, greatest(0, (x0 + 1404 * (300.0 / 226) / 2) * sx) AS px, greatest(0, y0 * sy - 3) AS py FROM c)""",
    """SELECT doc, page, stroke_id AS hl_id, round(px, 6) AS x, round(py, 6) AS y, round(least((x1 - x0) * sx, 612 - px), 6) AS w,
        round(least((y1 - y0) * sy + 6, 792 - py), 6) AS h FROM p""",
)
def highlighter_rects(t):
    drawn = strokes.drop_accidental_strokes(t("strokes"), t("stroke_points"))
    sizes = t("strokes").select("doc", "page", F.lit(612.0).alias("page_w"), F.lit(792.0).alias("page_h")).distinct()
    return rounded(spatial.highlighter_rects(drawn, sizes).drop("rect_id"), "x", "y", "w", "h")


@query(
    "canvas_rects",
    "strokes stroke_points",
    """lowest AS (SELECT doc, page, CASE WHEN max(y) > 1872 * 1.05 THEN 226 / 300.0 ELSE 1.0 END AS scale FROM stroke_points GROUP BY doc, page),
    b AS (SELECT doc, page, stroke_id, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM stroke_points GROUP BY doc, page, stroke_id),
    c AS (SELECT doc, page, stroke_id, greatest(8.0, width) / 2 AS half, x0 * scale + 702 AS l, x1 * scale + 702 AS r, y0 * scale AS t, y1 * scale AS b
        FROM b JOIN strokes s USING (doc, page, stroke_id) JOIN lowest USING (doc, page) WHERE pen_type IN (5, 18)),
    p AS (SELECT doc, page, stroke_id, greatest(0, (l - half) * 612 / 1404) AS x, greatest(0, (t - half) * 612 / 1404) AS y,
        least(612, (r + half) * 612 / 1404) AS r, least(792, (b + half) * 612 / 1404) AS b FROM c)""",
    """SELECT doc, page, stroke_id AS hl_id, round(x, 6) AS x, round(y, 6) AS y, round(r - x, 6) AS w, round(b - y, 6) AS h FROM p WHERE r > x AND b > y""",
)
def canvas_rects(t):
    sizes = t("strokes").select("doc", "page", F.lit(612.0).alias("page_w"), F.lit(792.0).alias("page_h")).distinct()
    return rounded(spatial.canvas_rects(t("strokes"), t("stroke_points"), sizes).drop("rect_id"), "x", "y", "w", "h")


@query(
    "stroke_styles",
    "strokes",
    "",
    """SELECT stroke_id, CASE pen_type WHEN 0 THEN 'black' WHEN 1 THEN 'gray' WHEN 2 THEN 'white' WHEN 3 THEN 'yellow' WHEN 4 THEN 'green' WHEN 5 THEN 'pink'
            ELSE 'unknown_' || pen_type END AS legacy_colour,
        CASE pen_type WHEN 1 THEN 'gray' WHEN 2 THEN 'white' WHEN 3 THEN 'yellow' WHEN 4 THEN 'green' WHEN 5 THEN 'pink'
            WHEN 6 THEN 'blue' WHEN 7 THEN 'red' WHEN 8 THEN 'gray_overlap' WHEN 9 THEN 'yellow' ELSE 'black' END AS stroke_colour,
        CAST(CASE pen_type WHEN 0 THEN 2.0 WHEN 2 THEN 1.2 WHEN 3 THEN 3.0 WHEN 5 THEN 15.0 WHEN 7 THEN 0.8 WHEN 12 THEN 2.0 WHEN 13 THEN 0.8 WHEN 15 THEN 1.2
            WHEN 16 THEN 3.0 WHEN 18 THEN 15.0 WHEN 21 THEN 2.0 ELSE 1.0 END AS DOUBLE) AS pen_factor FROM strokes""",
)
def stroke_styles(t):
    """The older format's colours, the stroke renderer's, and the base width of the pen, for every number."""
    number = F.col("pen_type")
    return t("strokes").select(
        "stroke_id", geometry.colour_name(number, legacy=True).alias("legacy_colour"), geometry.stroke_colour_name(number).alias("stroke_colour"), geometry.pen_width(number).alias("pen_factor")
    )


@query(
    "colour_names",
    "strokes",
    "",
    """SELECT stroke_id, CASE pen_type WHEN 0 THEN 'black' WHEN 1 THEN 'gray' WHEN 2 THEN 'white' WHEN 3 THEN 'yellow' WHEN 4 THEN 'green' WHEN 5 THEN 'pink'
        WHEN 6 THEN 'blue' WHEN 7 THEN 'red' WHEN 8 THEN 'gray_overlap' WHEN 9 THEN 'yellow' ELSE 'unknown_' || pen_type END AS color FROM strokes""",
)
def colour_names(t):
    return t("strokes").select("stroke_id", geometry.colour_name(F.col("pen_type")).alias("color"))


# --- strokes ---------------------------------------------------------------------------------------------------------


@query(
    "drop_accidental_strokes",
    "strokes stroke_points",
    """b AS (SELECT doc, page, stroke_id, min(x) AS x, min(y) AS y, max(x) - min(x) AS w, max(y) - min(y) AS h FROM stroke_points GROUP BY doc, page, stroke_id)""",
    "SELECT stroke_id, pen_type, x, y, w, h FROM strokes JOIN b USING (doc, page, stroke_id) WHERE pen_type IN (5, 18) AND (w >= 5 OR h >= 5)",
)
def drop_accidental_strokes(t):
    kept = strokes.drop_accidental_strokes(t("strokes"), t("stroke_points"))
    return kept.select("stroke_id", "pen_type", "x", "y", "w", "h")


@query(
    "stroked_pages",
    "doc_pages page_files",
    "",
    "SELECT uuid, page_id FROM doc_pages p WHERE EXISTS (SELECT 1 FROM page_files f WHERE f.uuid = p.uuid AND f.name = p.page_id || '.rm' AND f.size >= 100)",
)
def stroked_pages(t):
    return strokes.stroked_pages(t("doc_pages"), t("page_files")).select("uuid", "page_id")


MAPPED = """
mapped AS (SELECT uuid, page_idx, CASE WHEN bool_or(pdf_idx IS NOT NULL) OVER (PARTITION BY uuid) THEN pdf_idx ELSE page_idx END AS source_idx FROM doc_pages)"""


@query("map_pages_to_source", "doc_pages", MAPPED, "SELECT uuid, page_idx, source_idx FROM mapped")
def map_pages_to_source(t):
    return strokes.map_pages_to_source(t("doc_pages")).select("uuid", "page_idx", "source_idx")


PAGE_COUNTS = """
counted AS (SELECT uuid, CAST(source_idx + 1 AS INTEGER) AS page, count(*) AS strokes FROM page_strokes JOIN mapped USING (uuid, page_idx)
    WHERE source_idx IS NOT NULL GROUP BY uuid, source_idx)"""


@query("page_stroke_counts", "doc_pages page_strokes", MAPPED + "," + PAGE_COUNTS, "SELECT uuid, page, strokes FROM counted")
def page_stroke_counts(t):
    return strokes.page_stroke_counts(t("page_strokes"), t("doc_pages")).select("uuid", "page", "strokes")


@query(
    "stroked_page_list",
    "doc_pages page_strokes",
    MAPPED + "," + PAGE_COUNTS,
    "SELECT uuid, string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) AS pages FROM counted GROUP BY uuid",
)
def stroked_page_list(t):
    counts = strokes.page_stroke_counts(t("page_strokes"), t("doc_pages"))
    return strokes.stroked_page_list(counts).select("uuid", F.array_join("pages", ",").alias("pages"))


@query(
    "stroke_stats",
    "strokes stroke_points",
    """p AS (SELECT stroke_id, count(*) AS points, min(x) AS x, max(x) - min(x) AS w, avg(width) FILTER (width > 0) AS mean_width FROM stroke_points GROUP BY stroke_id)""",
    """SELECT stroke_id, coalesce(points, 0) AS points, x, w, round(mean_width, 6) AS mean_width, round(CASE WHEN mean_width IS NULL THEN greatest(0.5, width)
        WHEN pen_type IN (5, 18) THEN greatest(8.0, mean_width / 20 * width) ELSE greatest(0.5, least(mean_width / 20 * width, 5.0)) END, 6) AS drawn_width
    FROM strokes LEFT JOIN p USING (stroke_id)""",
)
def stroke_stats(t):
    stats = strokes.stroke_stats(t("strokes"), t("stroke_points"))
    return rounded(stats.select("stroke_id", "points", "x", "w", "mean_width", "drawn_width"), "mean_width", "drawn_width")


@query(
    "page_stroke_box",
    "strokes stroke_points",
    """b AS (SELECT doc, page, min(x) - 20 AS x, min(y) - 20 AS y, max(x) + 20 AS r, max(y) + 20 AS b FROM stroke_points
        WHERE stroke_id IN (SELECT stroke_id FROM strokes WHERE pen_type NOT IN (6, 8)) GROUP BY doc, page)""",
    """SELECT doc, page, coalesce(x, 0) AS x, coalesce(y, 0) AS y, coalesce(r - x, 1404) AS w, coalesce(b - y, 1872) AS h
    FROM (SELECT DISTINCT doc, page FROM strokes) s LEFT JOIN b USING (doc, page)""",
)
def page_stroke_box(t):
    return strokes.page_stroke_box(t("strokes"), t("stroke_points"))


@query(
    "canvas_shift",
    "strokes stroke_points",
    """b AS (SELECT doc, page, least(0, min(x)) AS x0, least(0, min(y)) AS y0, greatest(0, max(x)) AS x1, greatest(0, max(y)) AS y1
        FROM stroke_points JOIN strokes USING (doc, page, stroke_id) WHERE pen_type NOT IN (6, 8) GROUP BY doc, page)""",
    """SELECT doc, page, CASE WHEN x0 < -50 AND x1 - x0 <= 1404 THEN -x0 ELSE 0.0 END AS shift_x, CASE WHEN y0 < -50 AND y1 - y0 <= 1872 THEN -y0 ELSE 0.0 END AS shift_y
    FROM (SELECT DISTINCT doc, page FROM strokes) LEFT JOIN b USING (doc, page)""",
)
def canvas_shift(t):
    return strokes.canvas_shift(t("strokes"), t("stroke_points"))


@query(
    "page_extent",
    "strokes stroke_points rects",
    """c AS (SELECT doc, page, x, y FROM stroke_points JOIN strokes USING (doc, page, stroke_id) WHERE pen_type NOT IN (6, 8) UNION ALL SELECT doc, page, x, y FROM rects UNION ALL SELECT doc, page, x + w, y + h FROM rects),
    b AS (SELECT doc, page, min(x) + 702 AS l, max(x) + 702 AS r, min(y) AS t, max(y) AS b FROM c GROUP BY doc, page),
    s AS (SELECT doc, page, CASE WHEN l < 0 THEN 8 - l ELSE 0 END AS sx, CASE WHEN t < 0 THEN 8 - t ELSE 0 END AS sy, r, b FROM b)""",
    """SELECT doc, page, CAST(sx AS DOUBLE) AS shift_x, CAST(sy AS DOUBLE) AS shift_y, CAST(CASE WHEN r + sx > 1404 THEN ceil(r + sx) + 8 ELSE 1404 END AS BIGINT) AS width,
        CAST(CASE WHEN b + sy + 8 < 936 THEN greatest(ceil(b + sy + 8), 240) WHEN b + sy > 1872 THEN ceil(b + sy) + 8 ELSE 1872 END AS BIGINT) AS height FROM s""",
)
def page_extent(t):
    return strokes.page_extent(t("strokes"), t("stroke_points"), t("rects"))


@query(
    "smooth_widths",
    "curves curve_points",
    """w AS (SELECT p.stroke_id, p.pt, s.pen_type, s.width AS pw, CASE WHEN p.width > 0 THEN p.width ELSE 1.0 END / 20.0 AS base, p.tilt
        FROM curve_points p JOIN curves s USING (doc, page, stroke_id)),
    v AS (SELECT stroke_id, pt, CASE WHEN pen_type IN (5, 18) THEN greatest(8.0, pw) ELSE greatest(0.5, least(25.0, base * pw
        * CASE WHEN pen_type IN (1, 7, 13, 14, 23) THEN 1.21 ELSE 1.2 END
        * CASE WHEN pen_type = 23 THEN 1.0 WHEN pen_type IN (1, 7, 13, 14) THEN 1.01 WHEN pen_type IN (4, 17) THEN 0.7 ELSE 1.0 END
        * CASE WHEN pen_type IN (1, 7, 13, 14, 23) THEN 1.0 ELSE 0.5 END
        * CASE WHEN tilt > 10 THEN 1.0 + least(tilt / 255.0, 1.0) * 1.54 ELSE 1.0 END)) END AS raw FROM w)""",
    """SELECT stroke_id, pt, round(raw, 6) AS raw_width, round(CASE WHEN count(*) OVER (PARTITION BY stroke_id) < 3 THEN raw
        ELSE avg(raw) OVER (PARTITION BY stroke_id ORDER BY pt ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) END, 6) AS smooth_width FROM v""",
)
def smooth_widths(t):
    smoothed = strokes.smooth_widths(t("curves"), t("curve_points"))
    return rounded(smoothed.select("stroke_id", "pt", "raw_width", "smooth_width"), "raw_width", "smooth_width")


@query(
    "smooth_tilts",
    "curve_points",
    """e AS (SELECT stroke_id, count(*) AS n, min(pt) FILTER (tilt > 10) AS a, arg_min(tilt, pt) FILTER (tilt > 10) AS ta,
        max(pt) FILTER (tilt > 10) AS z, arg_max(tilt, pt) FILTER (tilt > 10) AS tz FROM curve_points GROUP BY stroke_id),
    f AS (SELECT stroke_id, pt, n, CASE WHEN n < 3 THEN tilt WHEN pt < a THEN ta WHEN pt > z THEN tz ELSE tilt END AS v FROM curve_points JOIN e USING (stroke_id))""",
    """SELECT stroke_id, pt, round(CASE WHEN n < 3 THEN v ELSE avg(v) OVER (PARTITION BY stroke_id ORDER BY pt ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) END, 6) AS smooth_tilt FROM f""",
)
def smooth_tilts(t):
    return rounded(strokes.smooth_tilts(t("curve_points")).select("stroke_id", "pt", "smooth_tilt"), "smooth_tilt")


@query(
    "page_tags",
    "doc_pages page_tag_rows",
    "",
    "SELECT uuid, CAST(page_idx + 1 AS INTEGER) AS page, string_agg(tag, ',' ORDER BY tag_idx) AS tags FROM page_tag_rows JOIN doc_pages USING (source_id, uuid, page_id) GROUP BY uuid, page_idx",
)
def page_tags(t):
    pages = t("doc_pages").withColumn("page", F.col("page_idx") + 1)
    return notes.with_page_tags(pages, t("page_tag_rows")).select("uuid", "page", F.array_join("tags", ",").alias("tags"))


@query(
    "assemble_ocr_text",
    "ocr_words",
    f"""w AS (SELECT * EXCLUDE (word), {trimmed_sql('word')} AS word FROM ocr_words),
    l AS (SELECT doc, page, block, par, line, string_agg(word, ' ' ORDER BY pos) FILTER (word <> '' AND conf >= 0) AS t,
        coalesce(sum(conf) FILTER (word <> '' AND conf >= 0), 0) AS c, count(*) FILTER (word <> '' AND conf >= 0) AS n FROM w GROUP BY doc, page, block, par, line),
    p AS (SELECT doc, page, coalesce(string_agg(t, chr(10) ORDER BY block, par, line), '') AS text, CASE WHEN sum(n) > 0 THEN sum(c) / sum(n) ELSE 0 END AS c FROM l GROUP BY doc, page)""",
    "SELECT doc, page, text, round(c, 6) AS confidence, text <> '' AND c < 30 AS is_low FROM p",
)
def assemble_ocr_text(t):
    return rounded(notes.assemble_ocr_text(t("ocr_words")), "confidence")
