"""Pen strokes and pages: boxes, widths, tilts, extents, page numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.geometry import ERASERS, HIGHLIGHTERS, PENCILS, SCREEN_HEIGHT, SCREEN_WIDTH
from marginalia.operators.ordered import HOT_ROWS, centred_mean

STROKE = ["doc", "page", "stroke_id"]

# Smallest real stroke, smallest page file with strokes, page growth and cropping, width and tilt scales.
MIN_STROKE = 5
MIN_PAGE_FILE = 100
MARGIN = 8
CROP_BELOW = 0.5
MIN_HEIGHT = 240
RAW_WIDTH = 20.0
PRESSURE_SCALE = 1.2
PENCIL_PRESSURE_SCALE = 1.21
PENCIL_SCALE = 1.01
FINELINERS = [4, 17]
FINELINER_SCALE = 0.7
SHADER = 23
INK_SCALE = 0.5
REAL_TILT = 10
TILT_RANGE = 255.0
TILT_GAIN = 1.54


def stroke_bounds(points: DataFrame) -> DataFrame:
    """The box of each stroke's points."""
    box = points.groupBy(*STROKE).agg(
        F.min("x").alias("x"), F.min("y").alias("y"), F.max("x").alias("right"), F.max("y").alias("bottom")
    )
    return box.select(*STROKE, "x", "y", (F.col("right") - F.col("x")).alias("w"), (F.col("bottom") - F.col("y")).alias("h"))


def padded_stroke_boxes(strokes: DataFrame, points: DataFrame) -> DataFrame:
    """Boxes grown by half the pen's width; the corner stays on the page, the size does not shrink."""
    half = F.col("width") / 2.0
    boxes = strokes.join(stroke_bounds(points), STROKE)
    return boxes.select(
        *STROKE,
        "pen_type",
        "color",
        F.greatest(F.lit(0.0), F.col("x") - half).alias("x"),
        F.greatest(F.lit(0.0), F.col("y") - half).alias("y"),
        (F.col("w") + 2 * half).alias("w"),
        (F.col("h") + 2 * half).alias("h"),
    )


def drop_accidental_strokes(strokes: DataFrame, points: DataFrame) -> DataFrame:
    """Highlighter strokes with their box, without taps that are tiny both ways."""
    drawn = strokes.filter(F.col("pen_type").isin(HIGHLIGHTERS)).join(stroke_bounds(points), STROKE)
    return drawn.filter((F.col("w") >= MIN_STROKE) | (F.col("h") >= MIN_STROKE))


def stroked_pages(pages: DataFrame, manifest: DataFrame) -> DataFrame:
    """Pages whose stroke file is large enough to hold strokes."""
    files = manifest.filter((F.col("ext") == ".rm") & (F.col("size") >= MIN_PAGE_FILE))
    files = files.select("source_id", "uuid", F.regexp_replace("name", "\\.rm\\z", "").alias("page_id"))
    return pages.join(files, ["source_id", "uuid", "page_id"], "left_semi")


def map_pages_to_source(pages: DataFrame, identity: bool = False) -> DataFrame:
    """Adds ``source_idx``: the redirect when the document has any, else the page's own position.

    In a document with redirects a page without one was inserted; its ``source_idx`` is null.
    """
    if identity:
        return pages.withColumn("source_idx", F.col("page_idx"))
    key = ["source_id", "uuid"]
    redirected = pages.groupBy(*key).agg(F.bool_or(F.col("pdf_idx").isNotNull()).alias("redirected"))
    target = F.when(F.col("redirected"), F.col("pdf_idx")).otherwise(F.col("page_idx"))
    return pages.join(redirected, key).withColumn("source_idx", target).drop("redirected")


def page_stroke_counts(strokes: DataFrame, pages: DataFrame) -> DataFrame:
    """Strokes per source page ``(source_id, uuid, page_idx)``; pages with the same target add up."""
    key = ["source_id", "uuid", "page_idx"]
    counted = strokes.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    placed = map_pages_to_source(pages).filter(F.col("source_idx").isNotNull()).select(*key, "source_idx")
    return (
        counted.join(placed, key)
        .groupBy("source_id", "uuid", (F.col("source_idx") + 1).alias("page"))
        .agg(F.sum("n").alias("strokes"))
    )


def stroked_page_list(counts: DataFrame) -> DataFrame:
    """Per document the sorted numbers of its pages with strokes."""
    return counts.groupBy("source_id", "uuid").agg(F.array_sort(F.collect_set("page")).alias("pages"))


def stroke_stats(strokes: DataFrame, points: DataFrame) -> DataFrame:
    """Per stroke: points, box, mean positive raw width, and the width it is drawn with."""
    per_stroke = points.groupBy(*STROKE).agg(
        F.count(F.lit(1)).alias("points"),
        F.min("x").alias("x"),
        F.min("y").alias("y"),
        (F.max("x") - F.min("x")).alias("w"),
        (F.max("y") - F.min("y")).alias("h"),
        F.avg(F.when(F.col("width") > 0, F.col("width"))).alias("mean_width"),
    )
    joined = strokes.withColumnRenamed("width", "pen_width").join(per_stroke, STROKE, "left")
    scaled = F.col("mean_width") / RAW_WIDTH * F.col("pen_width")
    drawn = (
        F.when(F.col("mean_width").isNull(), F.greatest(F.lit(0.5), F.col("pen_width")))
        .when(F.col("pen_type").isin(HIGHLIGHTERS), F.greatest(F.lit(8.0), scaled))
        .otherwise(F.greatest(F.lit(0.5), F.least(scaled, F.lit(5.0))))
    )
    return joined.withColumn("points", F.coalesce("points", F.lit(0))).withColumn("drawn_width", drawn)


def drawn_points(strokes: DataFrame, points: DataFrame) -> DataFrame:
    """Points of all strokes but erasers."""
    return points.join(strokes.filter(~F.col("pen_type").isin(ERASERS)).select(*STROKE), STROKE, "left_semi")


def page_stroke_box(strokes: DataFrame, points: DataFrame, padding: float = 20.0) -> DataFrame:
    """Box of all strokes of a page but erasers, padded; the whole screen when there are none."""
    box = drawn_points(strokes, points).groupBy("doc", "page").agg(
        (F.min("x") - padding).alias("x"), (F.min("y") - padding).alias("y"), (F.max("x") + padding).alias("r"), (F.max("y") + padding).alias("b")
    )
    pages = strokes.select("doc", "page").distinct().join(box, ["doc", "page"], "left")
    return pages.select(
        "doc",
        "page",
        F.coalesce("x", F.lit(0.0)).alias("x"),
        F.coalesce("y", F.lit(0.0)).alias("y"),
        F.coalesce(F.col("r") - F.col("x"), F.lit(float(SCREEN_WIDTH))).alias("w"),
        F.coalesce(F.col("b") - F.col("y"), F.lit(float(SCREEN_HEIGHT))).alias("h"),
    )


def canvas_shift(strokes: DataFrame, points: DataFrame) -> DataFrame:
    """Smallest shift per page that brings far-off content in, unless it would push other content out.

    Erasers are no content; a page without any is not shifted.
    """

    def shift(low: Column, high: Column, size: int) -> Column:
        return F.when((low < -50) & (high - low <= size), -low).otherwise(F.lit(0.0))

    def low(c: str) -> Column:
        return F.least(F.lit(0.0), F.min(c))

    def high(c: str) -> Column:
        return F.greatest(F.lit(0.0), F.max(c))

    shifts = drawn_points(strokes, points).groupBy("doc", "page").agg(
        shift(low("x"), high("x"), SCREEN_WIDTH).alias("shift_x"), shift(low("y"), high("y"), SCREEN_HEIGHT).alias("shift_y")
    )
    return strokes.select("doc", "page").distinct().join(shifts, ["doc", "page"], "left").fillna(0.0, ["shift_x", "shift_y"])


def page_extent(
    strokes: DataFrame,
    points: DataFrame,
    rects: DataFrame,
    truncate: bool = True,
    scale: float = 1.0,
    origin_x: float = SCREEN_WIDTH / 2,
) -> DataFrame:
    """Canvas of a page without background: shifted when content lies off its left or top edge, grown to the right
    and bottom, and cropped when the content ends in the upper half.  Erasers are no content; a page with nothing
    else is left out."""
    corners = drawn_points(strokes, points).select("doc", "page", "x", "y").unionByName(
        rects.select("doc", "page", F.inline(F.array(F.struct("x", "y"), F.struct((F.col("x") + F.col("w")).alias("x"), (F.col("y") + F.col("h")).alias("y")))))
    )
    box = corners.groupBy("doc", "page").agg(
        (F.min("x") * scale + origin_x).alias("left"),
        (F.max("x") * scale + origin_x).alias("right"),
        (F.min("y") * scale).alias("top"),
        (F.max("y") * scale).alias("bottom"),
    )
    c = F.col
    box = box.withColumn("shift_x", F.when(c("left") < 0, MARGIN - c("left")).otherwise(F.lit(0.0)))
    box = box.withColumn("shift_y", F.when(c("top") < 0, MARGIN - c("top")).otherwise(F.lit(0.0)))
    right, bottom = c("right") + c("shift_x"), c("bottom") + c("shift_y")
    width = F.when(right > SCREEN_WIDTH, F.ceil(right) + MARGIN).otherwise(F.lit(SCREEN_WIDTH))
    height = F.when(bottom > SCREEN_HEIGHT, F.ceil(bottom) + MARGIN).otherwise(F.lit(SCREEN_HEIGHT))
    if truncate:
        short = bottom + MARGIN < SCREEN_HEIGHT * CROP_BELOW
        height = F.when(short, F.greatest(F.ceil(bottom + MARGIN), F.lit(MIN_HEIGHT))).otherwise(height)
    return box.select("doc", "page", "shift_x", "shift_y", width.cast("bigint").alias("width"), height.cast("bigint").alias("height"))


def segment_width(pen: Column, pen_width: Column, raw_width: Column, tilt: Column) -> Column:
    """Drawn width at one point, by pen, pressure and tilt."""
    pencil = pen.isin(PENCILS)
    scale = (
        F.when(pen == SHADER, F.lit(1.0)).when(pencil, F.lit(PENCIL_SCALE)).when(pen.isin(FINELINERS), F.lit(FINELINER_SCALE)).otherwise(F.lit(1.0))
    )
    pressure = F.when(pencil, F.lit(PENCIL_PRESSURE_SCALE)).otherwise(F.lit(PRESSURE_SCALE))
    ink = F.when(pencil, F.lit(1.0)).otherwise(F.lit(INK_SCALE))
    raw = F.when(raw_width > 0, raw_width).otherwise(F.lit(1.0))
    width = raw / RAW_WIDTH * pen_width * pressure * scale * ink
    leaning = F.when(tilt > REAL_TILT, 1.0 + F.least(tilt / TILT_RANGE, F.lit(1.0)) * TILT_GAIN).otherwise(F.lit(1.0))
    clamped = F.greatest(F.lit(0.5), F.least(width * leaning, F.lit(25.0)))
    return F.when(pen.isin(HIGHLIGHTERS), F.greatest(F.lit(8.0), pen_width)).otherwise(clamped)


def _smoothed(df: DataFrame, value: str, name: str, half: int, limit: int, sizes: DataFrame) -> DataFrame:
    """Centred mean of strokes with three points or more (column ``n``); shorter strokes keep their values."""
    mean = centred_mean(df, STROKE, ["pt"], F.col(value), "_mean", half, limit, sizes)
    return mean.withColumn(name, F.when(F.col("n") < 3, F.col(value)).otherwise(F.col("_mean"))).drop("_mean", "n")


def smooth_widths(strokes: DataFrame, points: DataFrame, limit: int = HOT_ROWS) -> DataFrame:
    """Drawn width per point, averaged over five neighbouring points."""
    sized = points.groupBy(*STROKE).agg(F.count(F.lit(1)).alias("n"))
    pens = strokes.select(*STROKE, "pen_type", F.col("width").alias("pen_width")).join(sized, STROKE)
    width = segment_width(F.col("pen_type"), F.col("pen_width"), F.col("width"), F.col("tilt"))
    raw = points.join(pens, STROKE).select(*STROKE, "pt", "n", width.alias("raw_width"))
    return _smoothed(raw, "raw_width", "smooth_width", 2, limit, points)


def smooth_tilts(points: DataFrame, limit: int = HOT_ROWS) -> DataFrame:
    """Tilt per point: the flat ends take the nearest real value, then nine neighbouring points are averaged."""
    real = F.col("tilt") > REAL_TILT
    ends = points.groupBy(*STROKE).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(real, F.struct("pt", "tilt"))).alias("head"),
        F.max(F.when(real, F.struct("pt", "tilt"))).alias("tail"),
    )
    filled = (
        F.when(F.col("n") < 3, F.col("tilt"))
        .when(F.col("pt") < F.col("head.pt"), F.col("head.tilt"))
        .when(F.col("pt") > F.col("tail.pt"), F.col("tail.tilt"))
        .otherwise(F.col("tilt"))
    )
    raw = points.join(ends, STROKE).select(*STROKE, "pt", "n", filled.alias("filled_tilt"))
    return _smoothed(raw, "filled_tilt", "smooth_tilt", 4, limit, points)
