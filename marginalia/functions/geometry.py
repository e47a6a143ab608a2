"""Box arithmetic, coordinate spaces, colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Screen of the capturing tablet in pixels, and the two resolutions its newer format mixes.
SCREEN_WIDTH = 1404
SCREEN_HEIGHT = 1872
LOGICAL_DPI = 300
PHYSICAL_DPI = 226

# Colour numbers of the capture format.
COLOURS = {
    0: "black",
    1: "gray",
    2: "white",
    3: "yellow",
    4: "green",
    5: "pink",
    6: "blue",
    7: "red",
    8: "gray_overlap",
    9: "yellow",
}
LEGACY_COLOURS = {number: COLOURS[number] for number in range(6)}

# Pen numbers and their base width factor.
ERASERS = [6, 8]
HIGHLIGHTERS = [5, 18]
PENCILS = [1, 7, 13, 14, 23]
PEN_WIDTH = {
    0: 2.0,
    1: 1.0,
    2: 1.2,
    3: 3.0,
    4: 1.0,
    5: 15.0,
    7: 0.8,
    12: 2.0,
    13: 0.8,
    14: 1.0,
    15: 1.2,
    16: 3.0,
    17: 1.0,
    18: 15.0,
    21: 2.0,
}


def _lookup(table: dict, key: Column, fallback: Column) -> Column:
    entries = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(entries, key), fallback)


def colour_name(number: Column, legacy: bool = False) -> Column:
    unknown = F.concat(F.lit("unknown_"), number.cast("string"))
    return _lookup(LEGACY_COLOURS if legacy else COLOURS, number, unknown)


def stroke_colour_name(number: Column) -> Column:
    return _lookup(COLOURS, number, F.lit("black"))


def pen_width(pen: Column) -> Column:
    return _lookup(PEN_WIDTH, pen, F.lit(1.0))


def overlap_ratio(y1: Column, h1: Column, y2: Column, h2: Column) -> Column:
    """Shared height as a part of the lower box's height."""
    shared = F.greatest(F.lit(0.0), F.least(y1 + h1, y2 + h2) - F.greatest(y1, y2))
    return shared / F.greatest(F.lit(1e-6), F.least(h1, h2))


def axis_gap(start1: Column, size1: Column, start2: Column, size2: Column) -> Column:
    return F.greatest(F.lit(0.0), start2 - (start1 + size1), start1 - (start2 + size2))


def column_side(x: Column, w: Column, gutter: Column) -> Column:
    """0 on an undivided page or left of the gutter, 1 right of it."""
    return F.when(gutter.isNull() | (x + w / 2.0 < gutter), F.lit(0)).otherwise(F.lit(1))


def centred_to_page(x: Column, y: Column, w: Column, h: Column, page_w: Column, page_h: Column) -> dict[str, Column]:
    """Newer capture format (origin at the top centre, 300/226 dpi) to page points."""
    logical_w = SCREEN_WIDTH * (LOGICAL_DPI / PHYSICAL_DPI)
    logical_h = SCREEN_HEIGHT * (LOGICAL_DPI / PHYSICAL_DPI)
    sx, sy = page_w / logical_w, page_h / logical_h
    return {"x": (x + logical_w / 2) * sx, "y": y * sy, "w": w * sx, "h": h * sy}


def screen_to_page(x: Column, y: Column, w: Column, h: Column, page_w: Column, page_h: Column) -> dict[str, Column]:
    """Older capture format (screen pixels, origin at the top left) to page points."""
    sx, sy = page_w / SCREEN_WIDTH, page_h / SCREEN_HEIGHT
    return {"x": x * sx, "y": y * sy, "w": w * sx, "h": h * sy}


def canvas_to_page(
    x0: Column, y0: Column, x1: Column, y1: Column, page_w: Column, scale: Column | float = PHYSICAL_DPI / LOGICAL_DPI
) -> dict[str, Column]:
    """Corners in capture space, through the drawing canvas, to page points."""
    per_point = F.lit(float(SCREEN_WIDTH)) / page_w
    origin = SCREEN_WIDTH / 2
    left, right = (x0 * scale + origin) / per_point, (x1 * scale + origin) / per_point
    top, bottom = y0 * scale / per_point, y1 * scale / per_point
    return {"x": left, "y": top, "w": right - left, "h": bottom - top}


def padded_on_page(box: dict[str, Column], page_w: Column, page_h: Column, pad: float = 3.0) -> dict[str, Column]:
    """Grow a box up and down by ``pad`` and keep it on the page."""
    x = F.greatest(F.lit(0.0), box["x"])
    y = F.greatest(F.lit(0.0), box["y"] - pad)
    return {"x": x, "y": y, "w": F.least(box["w"], page_w - x), "h": F.least(box["h"] + 2 * pad, page_h - y)}
