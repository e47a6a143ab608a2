"""Text under highlight boxes, page gutters, reading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.geometry import (
    HIGHLIGHTERS,
    LOGICAL_DPI,
    PHYSICAL_DPI,
    SCREEN_HEIGHT,
    SCREEN_WIDTH,
    canvas_to_page,
    centred_to_page,
    column_side,
    padded_on_page,
)
from marginalia.functions.text import trimmed
from marginalia.operators.ordered import HOT_ROWS, OrderedGroups, hot_groups, split_at

PAGE = ["doc", "page"]

# Text a column must hold, and the part of the text that may cross the middle.
MIN_COLUMN_CHARS = 50
MAX_CROSSING = 0.30

# How far below the screen strokes of the finer capture reach, and the least width of a highlighter.
FINE_CAPTURE = 1.05
HIGHLIGHTER_WIDTH = 8.0

# Grid of the range joins on busy pages, in page points: a sixth of a page high and as wide as most, so that few words and boxes lie in two.
CELL_W = 1024
CELL_H = 128

# Words of a page that are compared with all its boxes; those of larger pages only within a cell.
PAGE_WORDS = 5_000


def detect_gutters(blocks: DataFrame) -> DataFrame:
    """Pages with a gutter down the middle: enough text wholly on both sides and little across."""
    weight, middle = F.length(trimmed(F.col("text"))), F.col("page_width") / 2.0
    left, right = F.col("x1") <= middle, F.col("x0") >= middle
    sides = (
        blocks.filter(F.col("page_width") > 0)
        .groupBy(*PAGE)
        .agg(
            F.max(middle).alias("gutter_x"),
            F.sum(F.when(left, weight).otherwise(0)).alias("left_chars"),
            F.sum(F.when(~left & right, weight).otherwise(0)).alias("right_chars"),
            F.sum(weight).alias("all_chars"),
        )
    )
    enough = (F.col("left_chars") >= MIN_COLUMN_CHARS) & (F.col("right_chars") >= MIN_COLUMN_CHARS)
    crossing = F.col("all_chars") - F.col("left_chars") - F.col("right_chars")
    return sides.filter(enough & (crossing / F.col("all_chars") <= MAX_CROSSING)).select(*PAGE, "gutter_x")


def with_side(df: DataFrame, gutters: DataFrame) -> DataFrame:
    """Adds ``side``, the column of the page the box's centre lies in."""
    sided = df.join(gutters.select(*PAGE, "gutter_x"), PAGE, "left")
    return sided.withColumn("side", column_side(F.col("x"), F.col("w"), F.col("gutter_x"))).drop("gutter_x")


def union_boxes(rects: DataFrame, keys: tuple[str, ...] = ("doc", "page", "hl_id")) -> DataFrame:
    """The box around all boxes of each group."""
    box = rects.groupBy(*keys).agg(
        F.min("x").alias("x"),
        F.min("y").alias("y"),
        F.max(F.col("x") + F.col("w")).alias("right"),
        F.max(F.col("y") + F.col("h")).alias("bottom"),
    )
    return box.select(*keys, "x", "y", (F.col("right") - F.col("x")).alias("w"), (F.col("bottom") - F.col("y")).alias("h"))


def reading_order(df: DataFrame, gutters: DataFrame, limit: int = HOT_ROWS) -> DataFrame:
    """Adds ``rank``, 1-based: column, then top to bottom, left to right, ``seq`` on ties.  Boxless rows come first."""
    return OrderedGroups(with_side(df, gutters), PAGE, ["side", "y", "x", "seq"], limit, df).row_number("rank").result()


def _cells(low: Column, high: Column, size: int) -> Column:
    return F.sequence(F.floor(low / size), F.floor(high / size))


def text_under_rects(rects: DataFrame, words: DataFrame, gutters: DataFrame, page_words: int = PAGE_WORDS) -> DataFrame:
    """Text of each highlight: the words that share area with any of its boxes, once each, in reading order.

    Words and boxes are dealt by page, once, and the highlights are put together where they meet.  On a page of more than
    ``page_words`` words they meet in grid cells, so a busy page spreads over many tasks; a pair counts in the one cell that
    holds the corner where its overlap starts.  The boxes, which are fewer, carry the page's gutter to the words.  A box
    goes on without words where it meets none, so a highlight without words has an empty text.
    """
    busy, _ = hot_groups(words, PAGE, page_words)
    if busy is None:
        return _text_on_pages(rects, words, gutters)
    (boxes, busy_boxes), (words, busy_words) = split_at(rects, PAGE, busy), split_at(words, PAGE, busy)
    return _text_on_pages(boxes, words, gutters).unionByName(_text_in_cells(busy_boxes, busy_words, gutters))


def _met(rects: DataFrame, words: DataFrame, gutters: DataFrame) -> tuple[DataFrame, DataFrame, Column]:
    """Boxes with their corners and the page's gutter, words with an area, and whether they meet."""
    real = (F.col("w") > 0) & (F.col("h") > 0)
    boxes = rects.join(gutters.select(*PAGE, "gutter_x"), PAGE, "left").select(
        *PAGE, "hl_id", "gutter_x", F.col("x").alias("rx0"), F.col("y").alias("ry0"),
        (F.col("x") + F.col("w")).alias("rx1"), (F.col("y") + F.col("h")).alias("ry1"), real.alias("real"),
    )
    solid = words.filter((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))
    # What stays alike along a line stands side by side, and so does what changes: such rows pack far better.
    solid = solid.select(*[F.col(c).alias(f"w_{c}") for c in PAGE], "y0", "y1", "x0", "x1", "word_id", "word")
    overlap = (F.greatest("x0", "rx0") < F.least("x1", "rx1")) & (F.greatest("y0", "ry0") < F.least("y1", "ry1"))
    for column in PAGE:
        overlap = (F.col(column) == F.col(f"w_{column}")) & overlap
    return boxes, solid, overlap


def _texts(met: DataFrame) -> DataFrame:
    """(doc, page, hl_id, text) of boxes and the words they meet."""
    side = column_side(F.col("x0"), F.col("x1") - F.col("x0"), F.col("gutter_x")).alias("side")
    word = F.when(F.col("word_id").isNotNull(), F.struct(side, "y0", "x0", "word_id", "word"))
    found = met.groupBy(*PAGE, "hl_id").agg(F.array_sort(F.collect_set(word)).alias("found"))
    return found.select(*PAGE, "hl_id", F.trim(F.array_join(F.col("found.word"), " ")).alias("text"))


def _text_on_pages(rects: DataFrame, words: DataFrame, gutters: DataFrame) -> DataFrame:
    """``text_under_rects`` where all boxes and words of a page are compared."""
    boxes, solid, overlap = _met(rects, words, gutters)
    meet = F.col("real") & F.col("rx0").isNotNull() & F.col("ry0").isNotNull() & overlap
    # The page alone is the key, so that the join deals by it, and the grouping by highlight need not deal again.
    return _texts(boxes.join(solid.hint("merge"), meet, "left"))


def _text_in_cells(rects: DataFrame, words: DataFrame, gutters: DataFrame) -> DataFrame:
    """``text_under_rects`` where boxes and words of a grid cell are compared."""
    boxes, solid, overlap = _met(rects, words, gutters)
    across, down = _cells(F.col("rx0"), F.col("rx1"), CELL_W), _cells(F.col("ry0"), F.col("ry1"), CELL_H)
    boxes = boxes.withColumn("cx", F.explode_outer(F.when(F.col("real"), across))).withColumn("cy", F.explode_outer(F.when(F.col("real"), down)))
    placed = solid.withColumn("wx", F.explode(_cells(F.col("x0"), F.col("x1"), CELL_W))).withColumn("wy", F.explode(_cells(F.col("y0"), F.col("y1"), CELL_H)))
    here = (F.floor(F.greatest("x0", "rx0") / CELL_W) == F.col("cx")) & (F.floor(F.greatest("y0", "ry0") / CELL_H) == F.col("cy"))
    return _texts(boxes.join(placed, (F.col("cx") == F.col("wx")) & (F.col("cy") == F.col("wy")) & overlap & here, "left"))


def highlighter_rects(strokes: DataFrame, page_sizes: DataFrame) -> DataFrame:
    """Boxes of drawn highlighter strokes ``(doc, page, stroke_id, x, y, w, h)`` in page points, ready for the text join.

    ``page_sizes (doc, page, page_w, page_h)``; boxes grow a little up and down and stay on the page.
    """
    page_w, page_h = F.col("page_w"), F.col("page_h")
    box = centred_to_page(F.col("x"), F.col("y"), F.col("w"), F.col("h"), page_w, page_h)
    box = padded_on_page(box, page_w, page_h)
    return strokes.join(page_sizes, PAGE).select(
        *PAGE, F.col("stroke_id").alias("hl_id"), F.lit(0).alias("rect_id"), *[c.alias(n) for n, c in box.items()]
    )


def canvas_rects(strokes: DataFrame, points: DataFrame, page_sizes: DataFrame) -> DataFrame:
    """Boxes of drawn highlighter strokes in page points, as they lie on the drawing canvas; ready for the text join.

    On pages whose strokes reach well below the screen the capture is at the finer resolution and is scaled down.  A box
    grows by half the pen's width and is cut at the page's edges; strokes off the page have none.
    """
    lowest = points.groupBy(*PAGE).agg(F.max("y").alias("lowest"))
    drawn = strokes.filter(F.col("pen_type").isin(HIGHLIGHTERS)).select(*PAGE, "stroke_id", "width")
    corners = points.groupBy(*PAGE, "stroke_id").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    known = drawn.join(corners, PAGE + ["stroke_id"]).join(lowest, PAGE).join(page_sizes, PAGE)
    page_w, page_h = F.col("page_w"), F.col("page_h")
    scale = F.when(F.col("lowest") > SCREEN_HEIGHT * FINE_CAPTURE, PHYSICAL_DPI / LOGICAL_DPI).otherwise(1.0)
    box = canvas_to_page(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), page_w, scale)
    pad = F.greatest(F.lit(HIGHLIGHTER_WIDTH), F.col("width")) * 0.5 * page_w / SCREEN_WIDTH
    left, top = F.greatest(F.lit(0.0), box["x"] - pad), F.greatest(F.lit(0.0), box["y"] - pad)
    right, bottom = F.least(page_w, box["x"] + box["w"] + pad), F.least(page_h, box["y"] + box["h"] + pad)
    cut = known.select(*PAGE, F.col("stroke_id").alias("hl_id"), F.lit(0).alias("rect_id"), left.alias("x"), top.alias("y"), (right - left).alias("w"), (bottom - top).alias("h"))
    return cut.filter((F.col("w") > 0) & (F.col("h") > 0))
