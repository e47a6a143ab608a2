"""Text columns: names, hashes, quoting, links, dates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Blanks as the note format counts them, as a pattern and as a set, and characters no file name may hold.
BLANK = "[\\s\\p{Z}\\ufeff]"
BLANK_IN_LINE = "[ \\t\\x0B\\f\\r\\p{Z}\\ufeff]"
BLANKS = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
UNSAFE = '[\\x00-\\x1f<>:"/\\\\|?*]'
UNSAFE_PRINTABLE = '[<>:"/\\\\|?*]'


def trimmed(text: Column) -> Column:
    """Without leading and trailing blanks of any kind."""
    return F.trim(text, F.lit(BLANKS))


def without_tail(text: Column) -> Column:
    """Without trailing blanks of any kind."""
    return F.rtrim(text, F.lit(BLANKS))


def single_spaced(text: Column) -> Column:
    return trimmed(F.regexp_replace(text, f"{BLANK}+", " "))


def or_untitled(text: Column) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("Untitled"))


def without_extension(name: Column) -> Column:
    return F.regexp_replace(name, "(?i)\\.(pdf|epub)\\z", "")


def with_pdf_extension(name: Column) -> Column:
    return F.when(name.rlike("(?i)\\.pdf\\z"), name).otherwise(F.concat(name, F.lit(".pdf")))


def note_name(name: Column) -> Column:
    """File name of a document's note: extension first, then unsafe and control characters."""
    return or_untitled(single_spaced(F.regexp_replace(without_extension(name), UNSAFE, "")))


def image_name(name: Column) -> Column:
    """Base name of a document's page images: control characters become blanks, extensions go last."""
    cleaned = F.regexp_replace(F.regexp_replace(name, UNSAFE_PRINTABLE, ""), "[\\x1c-\\x1f\\x85]", " ")
    cleaned = single_spaced(cleaned)
    for extension in (".pdf", ".epub", ".PDF", ".EPUB"):
        cleaned = F.regexp_replace(cleaned, "\\" + extension + "\\z", "")
    return or_untitled(trimmed(cleaned))


def page_image(base: Column, page: Column, mtime_s: Column) -> Column:
    """``base_pN_hhhh.png``; the tail changes whenever the page's file does."""
    tail = F.lpad(F.lower(F.hex(mtime_s.bitwiseAND(F.lit(65535)))), 4, "0")
    return F.concat(base, F.lit("_p"), page.cast("string"), F.lit("_"), tail, F.lit(".png"))


# Units of a text that are weighted at once.
UNITS_AT_ONCE = 65_536


def djb2(text: Column) -> Column:
    """Unsigned 32-bit hash h = 33 h + unit over UTF-16 code units, starting at 5381.

    The units of a text are weighted with powers of 33 at once; a loop over its letters in column expressions took most
    of the time of the queries that hash.  Bytes that are no UTF-8 count as U+FFFD.
    """
    at_once = UNITS_AT_ONCE

    # The function refers to nothing of this module, so workers need not import it.
    @F.arrow_udf("bigint")
    def hashed(texts: pa.Array) -> pa.Array:
        powers = np.ones(at_once + 1, np.uint32)
        np.multiply.accumulate(np.full(at_once, 33, np.uint32), dtype=np.uint32, out=powers[1:])

        def one(text):
            if text is None:
                return None
            units, h = np.frombuffer(text.decode("utf-8", "replace").encode("utf-16-le"), "<u2"), 5381
            for start in range(0, len(units), at_once):
                part = units[start : start + at_once].astype(np.uint32)
                h = (h * int(powers[len(part)]) + int(np.dot(part, powers[: len(part)][::-1]))) % 2**32
            return h

        return pa.array([one(t) for t in texts.cast(pa.binary()).to_pylist()], pa.int64())

    return hashed(text)


def djb2_base36(text: Column) -> Column:
    return F.lower(F.conv(djb2(text).cast("string"), 10, 36))


def djb2_hex(text: Column) -> Column:
    return F.lower(F.hex(djb2(text)))


def highlight_id(uuid: Column, page: Column, text: Column) -> Column:
    """Identifier that stays the same when a document is extracted again."""
    return F.concat(uuid, F.lit(":p"), page.cast("string"), F.lit(":"), djb2_base36(text))


def yaml_escaped(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.replace(text, F.lit('"'), F.lit('\\"'))
    return F.replace(text, F.lit("\n"), F.lit("\\n"))


def quoted(text: Column) -> Column:
    """Every line as a block quote."""
    return F.concat(F.lit("> "), F.replace(text, F.lit("\n"), F.lit("\n> ")))


def shortened(text: Column, width: int = 100) -> Column:
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("…"))).otherwise(text)


def page_link(source: Column, page: Column, style: str = "pdfpp") -> Column:
    """Link to a page: ``pdfpp`` and ``obsidian`` anchors, or ``none``."""
    label = F.concat(F.lit("Page "), page.cast("string"))
    if style == "none":
        return label
    anchor = "#page" if style == "obsidian" else "#page="
    return F.concat(F.lit("[["), source, F.lit(anchor), page.cast("string"), F.lit("|"), label, F.lit("]]"))


def day(epoch_ms: Column) -> Column:
    """UTC calendar day of an epoch in milliseconds."""
    return F.date_format(utc_date(epoch_ms), "yyyy-MM-dd")


def utc_date(epoch_ms: Column) -> Column:
    """The date, whatever the session's time zone."""
    return F.date_from_unix_date(F.floor(epoch_ms / 86400000).cast("int"))


def millis(epoch: Column) -> Column:
    """Epoch seconds or milliseconds, as milliseconds."""
    epoch = epoch.cast("bigint")
    return F.when(epoch > 1000000000000, epoch).otherwise(epoch * 1000)


def relative_time(epoch: Column, now_ms: Column, style: str = "short") -> Column:
    """Age of a moment seen from ``now_ms``, in words."""
    gap = now_ms - millis(epoch)
    minutes, hours, days = (F.floor(gap / unit) for unit in (60000, 3600000, 86400000))

    def ago(count: Column, unit: str) -> Column:
        return F.concat(count.cast("string"), F.lit(f"{unit} ago"))

    unknown = epoch.isNull() | (epoch == 0)
    if style == "short":
        return (
            F.when(unknown | (minutes < 1), F.lit("just now"))
            .when(minutes < 60, ago(minutes, "m"))
            .when(hours < 24, ago(hours, "h"))
            .otherwise(ago(days, "d"))
        )
    moment, today = utc_date(millis(epoch)), utc_date(now_ms)
    dated = F.when(F.year(moment) == F.year(today), F.date_format(moment, "MMM d")).otherwise(
        F.date_format(moment, "MMM d, yyyy")
    )
    return (
        F.when(unknown, F.lit("Never"))
        .when(minutes < 1, F.lit("Just now"))
        .when(minutes < 60, ago(minutes, "m"))
        .when(hours < 24, ago(hours, "h"))
        .when(days == 1, F.lit("Yesterday"))
        .when(days < 7, ago(days, "d"))
        .when(days < 30, ago(F.floor(days / 7), "w"))
        .otherwise(dated)
    )


def ordered_list(value: Column, *order: Column | str) -> Column:
    """Aggregate: the group's values as one array in the given order."""
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    named = [k.alias(f"k{i}") for i, k in enumerate(keys)]
    rows = F.array_sort(F.collect_list(F.struct(*named, value.alias("v"))))
    return F.transform(rows, lambda r: r["v"])


def ordered_join(value: Column, separator: str, *order: Column | str) -> Column:
    """Aggregate: the group's texts joined in the given order."""
    return F.array_join(ordered_list(value, *order), separator)
