"""Notes: the managed section, its rendering and merging, and the typed blocks people put into it."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import (
    BLANK,
    BLANK_IN_LINE,
    BLANKS,
    day,
    note_name,
    ordered_join,
    ordered_list,
    page_link,
    quoted,
    shortened,
    trimmed,
    with_pdf_extension,
    without_extension,
    without_tail,
    yaml_escaped,
)

DOC_PAGE = ["doc", "page"]


@dataclass(frozen=True)
class Markers:
    """A pair of comments around the managed section."""

    name: str

    @property
    def start(self) -> str:
        return f"<!-- {self.name}:start -->"

    @property
    def end(self) -> str:
        return f"<!-- {self.name}:end -->"


# The first pair is written; any of them is read.  Notes of another tool are read and rewritten by passing its pairs.
MARKERS = (Markers("marginalia"), Markers("marginalia-v0"))

# Texts of the note format.
HEADING = {True: "## Pages", False: "## Highlights"}
EMPTY_SECTION = "_No highlights or annotations found in this document._"
KEEP_OUT = "<!-- The part between the start and end comments is written anew on every run; write above or below it. -->"
OCR_HEAD = "> [!note]- Handwriting (OCR)\n"
WARNING_HEAD = "> [!warning] Extraction warnings\n"
ORPHAN_HEAD = (
    "> [!warning] Preserved notes\n"
    "> The passages these notes stood under are gone. The notes stay here until you give them a new place.\n\n"
)
BLOCK_OPEN = "<!-- notes -->"
BLOCK_CLOSE = "<!-- /notes -->"
BLOCK = f"(?s){BLOCK_OPEN}(.*?){BLOCK_CLOSE}"
SECTION_START_KEY = "__section-start__"
MIN_CONFIDENCE = 30


# --- the managed section ---------------------------------------------------------------------------------------------


def _places(body: Column, wanted: list[str], name: str) -> dict[str, Column]:
    """Columns with the position of each marker, 0 when it does not occur; a search letter by letter only where one does."""
    return {f"{name}{i}": F.when(body.contains(text), F.instr(body, text)).otherwise(F.lit(0)) for i, text in enumerate(wanted)}


def _first_found(wanted: list[str], name: str) -> tuple[Column, Column]:
    """(position, marker) of the first generation that occurs; position 0 and null when none does."""
    at, marker = F.lit(0), F.lit(None).cast("string")
    for i, text in reversed(list(enumerate(wanted))):
        here = F.col(f"{name}{i}")
        at, marker = F.when(here > 0, here).otherwise(at), F.when(here > 0, F.lit(text)).otherwise(marker)
    return at, marker


def _tail(text: Column, start: Column) -> Column:
    return F.substring(text, start, F.length(text))


def split_managed_section(notes: DataFrame, markers: tuple[Markers, ...] = MARKERS, body: str = "body") -> DataFrame:
    """Adds ``before``, ``managed`` (between the markers), ``after`` and the two markers found; null without a section."""
    text = F.col(body)
    starts, ends = [m.start for m in markers], [m.end for m in markers]
    places = _places(text, starts, "_s") | _places(text, ends, "_e")
    (start, start_marker), (end, end_marker) = _first_found(starts, "_s"), _first_found(ends, "_e")
    df = notes.withColumns(places).withColumns({"_s": start, "_e": end, "_sm": start_marker, "_em": end_marker}).drop(*places)
    inner = F.col("_s") + F.length("_sm")
    whole = (F.col("_s") > 0) & (F.col("_e") >= inner)
    return df.withColumns(
        {
            "before": F.when(whole, F.substring(text, F.lit(1), F.col("_s") - 1)),
            "managed": F.when(whole, F.substring(text, inner, F.col("_e") - inner)),
            "after": F.when(whole, _tail(text, F.col("_e") + F.length("_em"))),
            "start_marker": F.when(whole, F.col("_sm")),
            "end_marker": F.when(whole, F.col("_em")),
        }
    ).drop("_s", "_e", "_sm", "_em")


def parse_highlights(notes: DataFrame, markers: tuple[Markers, ...] = MARKERS) -> DataFrame:
    """Highlights ``(doc, pos, text, page)`` of the managed section.

    Quoted lines add up until a quoted ``-- …#page=N`` line closes the highlight; lines outside quotes do not count.
    A note is split within its own row, so nothing is shuffled.
    """
    lines = F.filter(F.split("managed", "\n"), lambda line: line.startswith("> "))
    quote = F.array_join(F.transform(lines, lambda line: F.substring(line, 3, 1_000_000_000)), "\n")
    closing = f"(?md)^--{BLANK_IN_LINE}+[^\\n]*#page=?(\\d+)[^\\n]*$"
    texts = F.split("quote", closing)
    pages = F.regexp_extract_all("quote", F.lit(closing), F.lit(1))
    sections = split_managed_section(notes, markers).withColumn("quote", quote).select("doc", texts.alias("texts"), pages.alias("pages"))
    pieces = sections.select("doc", _each(F.arrays_zip(F.slice("texts", F.lit(1), F.size("pages")).alias("text"), F.col("pages").alias("page")), "h"))
    found = pieces.select("doc", "pos", trimmed(F.col("h.text")).alias("text"), F.col("h.page").cast("int").alias("page"))
    return found.filter(F.col("pos").isNotNull() & (F.col("text") != ""))


def _each(array: Column, name: str) -> Column:
    """Elements with their position.  The outer form, as for the inner one Spark infers a filter that computes the
    array a second time; a note without any gives one row with a null position."""
    return F.posexplode_outer(array).alias("pos", name)


def group_by_page(highlights: DataFrame, drawings: DataFrame, ocr: DataFrame) -> DataFrame:
    """Every page with content: its highlights in order, its drawing, its recognised handwriting.

    ``created_at``, the epoch in milliseconds of a highlight, is carried if ``highlights`` has it.
    """
    none = F.lit(None).cast("string")
    entry = F.struct("seq", "text", "color", *[c for c in ("created_at",) if c in highlights.columns])
    blank = F.lit(None).cast(highlights.select(entry.alias("h")).schema["h"].dataType)
    parts = (
        highlights.select(*DOC_PAGE, entry.alias("h"), none.alias("filename"), none.alias("ocr_text"))
        .unionByName(drawings.select(*DOC_PAGE, blank.alias("h"), "filename", none.alias("ocr_text")))
        .unionByName(ocr.select(*DOC_PAGE, blank.alias("h"), none.alias("filename"), "ocr_text"))
    )
    return parts.groupBy(*DOC_PAGE).agg(
        F.array_sort(F.collect_list("h")).alias("highlights"), F.max("filename").alias("filename"), F.max("ocr_text").alias("ocr_text")
    )


def with_page_tags(pages: DataFrame, page_tags: DataFrame) -> DataFrame:
    """Tags per 1-based page number, in the order they were listed (``tag_idx``)."""
    key = ["source_id", "uuid", "page_id"]
    listed = page_tags.join(pages.select(*key, "page"), key)
    return listed.groupBy("source_id", "uuid", "page").agg(ordered_list(F.col("tag"), "tag_idx").alias("tags"))


def format_highlight(text: Column, page: Column, colour: Column, source: Column, colours: bool, link_style: str) -> Column:
    lines = F.concat(quoted(text), F.lit("\n> -- "), page_link(source, page, link_style))
    if not colours:
        return lines
    note = F.concat(F.lit("\n<!-- highlight-color: "), colour, F.lit(" -->"))
    return F.concat(lines, F.when((colour != "yellow") & (colour != ""), note).otherwise(F.lit("")))


def render_section(
    docs: DataFrame,
    highlights: DataFrame,
    drawings: DataFrame,
    ocr: DataFrame,
    page_tags: DataFrame | None = None,
    colours: bool = True,
    grouped: bool = True,
    link_style: str = "pdfpp",
    markers: tuple[Markers, ...] = MARKERS,
) -> DataFrame:
    """(doc, section, highlight_count): the managed section of each document ``(doc, pdf_name, is_notebook)``."""
    pages = group_by_page(highlights, drawings, ocr).join(docs.select("doc", "pdf_name"), "doc")
    head = F.lit("")
    if grouped:
        head = F.concat(F.lit("### Page "), F.col("page").cast("string"))
        if page_tags is not None:
            pages = pages.join(page_tags.select(*DOC_PAGE, "tags"), DOC_PAGE, "left")
            tags = F.array_join(F.transform("tags", lambda t: F.concat(F.lit("#"), t)), " ")
            head = F.concat(head, F.when(F.size("tags") > 0, F.concat(F.lit("  "), tags)).otherwise(F.lit("")))
        head = F.concat(head, F.lit("\n\n"))

    def block(h: Column) -> Column:
        text = format_highlight(h["text"], F.col("page"), h["color"], F.col("pdf_name"), colours, link_style)
        return F.concat(text, F.lit("\n\n"))

    def unless_blank(column: str, text: Column) -> Column:
        return F.when(F.coalesce(F.col(column), F.lit("")) != "", text).otherwise(F.lit(""))

    content = F.concat(
        head,
        F.array_join(F.transform("highlights", block), ""),
        unless_blank("filename", F.concat(F.lit("![["), F.col("filename"), F.lit("|500]]\n\n"))),
        unless_blank("ocr_text", F.concat(F.lit(OCR_HEAD), quoted(F.col("ocr_text")), F.lit("\n\n"))),
    )
    contents = pages.select("doc", "page", content.alias("content"), F.size("highlights").alias("n"))
    per_doc = contents.groupBy("doc").agg(ordered_join(F.col("content"), "", "page").alias("content"), F.sum("n").alias("n"))
    title = F.when(F.col("is_notebook"), HEADING[True]).otherwise(HEADING[False])
    section = F.concat(
        F.lit(markers[0].start + "\n"), title, F.lit("\n\n"), F.coalesce("content", F.lit(EMPTY_SECTION + "\n")), F.lit(markers[0].end)
    )
    joined = docs.join(per_doc, "doc", "left")
    return joined.select("doc", section.alias("section"), F.coalesce("n", F.lit(0)).alias("highlight_count"))


def render_notes(
    docs: DataFrame, sections: DataFrame, uuid_key: str = "remarkable_uuid", fallback_day: str = "1970-01-01"
) -> DataFrame:
    """Whole new notes: header, section, warnings.

    ``docs (doc, uuid, name, doc_type, last_modified, source_label, tags, warnings)``; dates come from the document.
    """
    notebook = F.col("doc_type") == "notebook"

    def line(text: str, value: Column) -> Column:
        return F.concat(F.lit(text), value, F.lit("\n"))

    dated = F.when(F.col("last_modified") > 0, day(F.col("last_modified"))).otherwise(F.lit(fallback_day))
    source_pdf = F.concat(F.lit('"[['), yaml_escaped(with_pdf_extension(F.col("name"))), F.lit(']]"'))
    label = F.concat(F.lit('"'), yaml_escaped(F.col("source_label")), F.lit('"'))
    tags = F.array_join(F.transform(F.array_distinct("tags"), lambda t: F.concat(F.lit("  - "), t, F.lit("\n"))), "")
    nothing = F.lit("")
    header = F.concat(
        F.lit("---\n"),
        line("title: ", F.concat(F.lit('"'), yaml_escaped(without_extension(F.col("name"))), F.lit('"'))),
        F.when(notebook, nothing).otherwise(line("source_pdf: ", source_pdf)),
        line("source_type: ", F.when(notebook, F.lit("notebook")).otherwise(F.lit("pdf"))),
        line("date_highlighted: ", dated),
        line("highlight_count: ", F.col("highlight_count").cast("string")),
        line(f"{uuid_key}: ", F.col("uuid")),
        F.when(F.coalesce("source_label", nothing) != "", line("source: ", label)).otherwise(nothing),
        F.when(F.size("tags") > 0, F.concat(F.lit("tags:\n"), tags)).otherwise(nothing),
        F.lit("---"),
    )
    listed = F.array_join(F.transform("warnings", lambda w: F.concat(F.lit("- "), w, F.lit("\n"))), "")
    notes = F.when(F.size("warnings") > 0, F.concat(F.lit("\n## Extraction Notes\n\n"), listed)).otherwise(nothing)
    body = F.concat(header, F.lit(f"\n\n{KEEP_OUT}\n\n"), F.col("section"), F.lit("\n"), notes)
    return docs.join(sections, "doc").select("doc", body.alias("body"), "section", "highlight_count")


def with_warning_callout(body: Column, warnings: Column) -> Column:
    """Put the run's warnings on top, unless a callout is there already."""
    listed = F.array_join(F.transform(warnings, lambda w: F.concat(F.lit("> - "), w)), "\n")
    due = (F.size(warnings) > 0) & ~body.contains("[!warning] Extraction warnings")
    return F.when(due, F.concat(F.lit(WARNING_HEAD), listed, F.lit("\n\n"), body)).otherwise(body)


# --- merging into notes that exist -----------------------------------------------------------------------------------


def _with_count(text: Column, count: Column) -> Column:
    """Refresh the first ``highlight_count`` line."""
    line = "(?smd)\\A(?<head>.*?^highlight_count:)\\s*\\d+$"
    return F.regexp_replace(text, F.lit(line), F.concat(F.lit("${head} "), count.cast("string")))


def merge_notes(existing: DataFrame, fresh: DataFrame, overwrite: bool = False, markers: tuple[Markers, ...] = MARKERS) -> DataFrame:
    """New bodies ``(doc, body)`` for ``fresh (doc, body, section, highlight_count)``.

    Of an existing note only the managed section and the header count change; without a section it is appended.
    ``overwrite`` takes the fresh note.  Typed blocks are carried over either way.
    """
    joined = split_managed_section(fresh.join(existing.select("doc", F.col("body").alias("old_body")), "doc", "left"), markers, "old_body")
    spliced = F.concat(_with_count(F.col("before"), F.col("highlight_count")), F.col("section"), F.col("after"))
    appended = F.concat(without_tail(F.col("old_body")), F.lit("\n\n"), F.col("section"), F.lit("\n"))
    kept = F.col("body") if overwrite else F.coalesce(spliced, appended)
    merged = joined.select("doc", "old_body", F.when(F.col("old_body").isNull(), F.col("body")).otherwise(kept).alias("body"))
    return _with_typed_notes(merged, markers)


def _stopping(markers: tuple[Markers, ...]) -> str:
    """A line that is blank or holds a marker alone."""
    names = "|".join(re.escape(m.name).replace("\\-", "-") for m in markers)
    return f"\\A[{BLANKS}]*+(\\z|<!--\\s*(/?notes|({names}):(start|end))\\s*-->\\x85?[{BLANKS}]*\\z)"


def _lines_above(text: Column, markers: tuple[Markers, ...]) -> Column:
    """The unbroken run of content lines at the end of a text, blank lines after it aside."""
    lines = F.split(without_tail(text), "\n")
    stops = F.transform(lines, lambda line, i: F.when(line.rlike(_stopping(markers)), i + 1).otherwise(F.lit(0)))
    last_stop = F.array_max(stops)
    return F.array_join(F.slice(lines, last_stop + 1, F.greatest(F.size(lines) - last_stop, F.lit(0))), "\n")


def anchor_key(anchor: Column) -> Column:
    """Anchor text without what changes on a fresh rendering: image hashes, embed sizes, blanks, case."""

    def where(text: Column, due: Column, changed: Column) -> Column:
        return F.when(due, changed).otherwise(text)

    # Most anchors are long passages without any of these, which a plain search tells sooner than a replacement.
    images = F.regexp_replace(anchor, "(?i)_p(\\d+)_[0-9a-f]+\\.(png|svg|jpg|jpeg)", "_p$1.$2")
    text = where(anchor, anchor.contains("_p") | anchor.contains("_P"), images)
    text = where(text, text.contains("]]"), F.regexp_replace(text, "\\|[^\\]]*\\]\\]", "]]"))
    text = F.replace(text, F.lit("\n"), F.lit(" "))
    text = where(text, text.rlike(f"[{BLANK}&&[^ ]]"), F.regexp_replace(text, BLANK, " "))
    key = F.lower(F.trim(where(text, text.contains("  "), F.regexp_replace(text, "  +", " "))))
    return F.coalesce(F.nullif(key, F.lit("")), F.lit(SECTION_START_KEY))


def _typed_blocks(notes: DataFrame, markers: tuple[Markers, ...], body: str, *carried: str) -> DataFrame:
    """The blocks of ``anchor_blocks`` with the columns ``carried``; a note without any has one row, with a null ``pos``."""
    sections = split_managed_section(notes, markers, body)
    section = F.concat("start_marker", "managed", "end_marker")
    sections = sections.select("doc", *carried, section.alias("section"))
    sections = sections.withColumn("gaps", F.split("section", BLOCK)).withColumn("inner", F.regexp_extract_all("section", F.lit(BLOCK), F.lit(1)))
    blocks = sections.select("doc", *carried, "gaps", "inner", _each(F.col("inner"), "typed"))
    gap = F.get("gaps", F.col("pos"))
    # The block before ends in a marker line, where the anchor stops, unless text follows on that very line.
    marker_line = F.concat(F.substring_index(F.get("inner", F.col("pos") - 1), "\n", -1), F.lit(BLOCK_CLOSE))
    near = F.when(F.col("pos") == 0, gap).otherwise(F.concat(marker_line, gap))
    blocks = blocks.withColumn("near", without_tail(near)).withColumn("above", _lines_above(F.col("near"), markers))
    upto = F.slice(F.arrays_zip(F.col("gaps").alias("gap"), F.col("inner").alias("typed")), F.lit(1), F.col("pos"))
    written = F.transform(upto, lambda p: F.concat(p["gap"], F.lit(BLOCK_OPEN), p["typed"], F.lit(BLOCK_CLOSE)))
    whole = F.concat(F.array_join(written, ""), gap)
    runs_on = (F.col("pos") > 0) & (F.col("above") == F.col("near"))
    anchor = F.when(runs_on, _lines_above(whole, markers)).otherwise(F.col("above"))
    return blocks.select("doc", *carried, "pos", anchor.alias("anchor_text"), trimmed(F.col("typed")).alias("content")).select(
        "doc", *carried, "pos", anchor_key(F.col("anchor_text")).alias("key"), "anchor_text", "content"
    )


def anchor_blocks(notes: DataFrame, markers: tuple[Markers, ...] = MARKERS, body: str = "body") -> DataFrame:
    """Typed blocks ``(doc, pos, key, anchor_text, content)`` of the managed section, with the lines they hang on."""
    return _typed_blocks(notes.select("doc", body), markers, body).filter(F.col("pos").isNotNull())


SLOT = "struct<pos:int,content:string>"
FILL = "struct<pos:int,content:string,filled:boolean>"
NOTE = "struct<pos:int,content:string,anchor_text:string>"


def carry_notes_forward(old_blocks: DataFrame, new_blocks: DataFrame) -> DataFrame:
    """Where each typed note goes: ``(doc, key, fills, orphans)``.

    Per document and anchor the notes queue up in order and fill the empty slots in order.  A slot that already holds
    the note at the head of the queue takes it out; what is left has no slot.  Both sides come out of single notes,
    so a group never exceeds one note, and rows are dealt by document once for all groupings that follow.
    """
    old = old_blocks.filter(F.col("content") != "").select(
        "doc", "key", F.struct("pos", "content", "anchor_text").alias("note"), F.lit(None).cast(SLOT).alias("slot")
    )
    new = new_blocks.select("doc", "key", F.lit(None).cast(NOTE).alias("note"), F.struct("pos", "content").alias("slot"))
    queues = old.unionByName(new).repartition("doc").groupBy("doc", "key").agg(
        F.array_sort(F.collect_list("note")).alias("queue"), F.array_sort(F.collect_list("slot")).alias("slots")
    )
    return _filled(queues)


def _filled(queues: DataFrame, *carried: str) -> DataFrame:
    """The queue of notes and the slots of each document and anchor as what ``carry_notes_forward`` returns."""

    def step(state: Column, slot: Column) -> Column:
        head = F.get(F.col("queue"), state["used"])["content"]
        empty = slot["content"] == ""
        takes = F.coalesce(F.when(empty, head.isNotNull()).otherwise(slot["content"] == head), F.lit(False))
        fill = F.struct(slot["pos"].alias("pos"), F.coalesce(F.when(empty, head), slot["content"]).alias("content"), (empty & takes).alias("filled"))
        return F.struct(
            F.when(takes, state["used"] + 1).otherwise(state["used"]).alias("used"),
            F.concat(state["fills"], F.array(fill)).alias("fills"),
        )

    start = F.struct(F.lit(0).alias("used"), F.array().cast(f"array<{FILL}>").alias("fills"))
    done = queues.withColumn("done", F.aggregate("slots", start, step))
    return done.select(
        "doc", "key", F.col("done.fills").alias("fills"), F.slice("queue", F.col("done.used") + 1, F.size("queue")).alias("orphans"),
        F.array_min(F.transform("queue", lambda n: n["pos"])).alias("first_pos"), *carried,
    )


def _summary(anchor: Column) -> Column:
    return shortened(trimmed(F.substring_index(anchor, "\n", 1)))


def _orphan_text(note: Column) -> Column:
    summary = _summary(note["anchor_text"])
    under = F.concat(F.lit("**Originally under:** `"), summary, F.lit("`\n"))
    return F.concat(
        F.when(note["anchor_text"] != "", under).otherwise(F.lit("")),
        F.lit(BLOCK_OPEN + "\n"),
        note["content"],
        F.lit("\n" + BLOCK_CLOSE + "\n"),
    )


def preserve_typed_notes(pairs: DataFrame, markers: tuple[Markers, ...] = MARKERS) -> DataFrame:
    """``(doc, old_body, body)`` to ``(doc, body)`` with every typed block of the old note.

    Notes without a slot end up in a callout at the end of the managed section; none is lost.
    """
    return _with_typed_notes(pairs.repartition("doc"), markers)


def _with_typed_notes(pairs: DataFrame, markers: tuple[Markers, ...]) -> DataFrame:
    """``preserve_typed_notes`` of pairs that are dealt by document: they pass once, and are neither kept nor dealt again.

    Both bodies give their blocks, and the first row of a new one carries it whole through the groupings, which are all
    within a document.
    """
    sides = F.array(*[F.struct(F.lit(old).alias("old"), F.col(c).alias("body")) for old, c in ((True, "old_body"), (False, "body"))])
    texts = pairs.select("doc", F.inline_outer(sides)).filter(~F.col("old") | F.col("body").isNotNull())
    blocks = _typed_blocks(texts, markers, "body", "old", "body")
    old, typed = F.col("old"), F.col("pos").isNotNull()
    # Blocks are grouped by a digest of their anchor, with what is shown of its text, not with the passages themselves.
    note = F.struct("pos", "content", _summary(F.col("anchor_text")).alias("anchor_text"))
    queues = blocks.groupBy("doc", F.sha2("key", 256).alias("key")).agg(
        F.array_sort(F.collect_list(F.when(old & typed & (F.col("content") != ""), note))).alias("queue"),
        F.array_sort(F.collect_list(F.when(~old & typed, F.struct("pos", "content")))).alias("slots"),
        F.collect_list(F.when(~old & (F.coalesce("pos", F.lit(0)) == 0), F.struct("body"))).alias("bodies"),
    )
    per_doc = _filled(queues, "bodies").groupBy("doc").agg(
        F.array_sort(F.flatten(F.collect_list("fills"))).alias("fills"),
        F.array_sort(F.collect_list(F.when(F.size("orphans") > 0, F.struct("first_pos", "orphans")))).alias("left"),
        F.flatten(F.collect_list("bodies")).alias("bodies"),
    )
    df = split_managed_section(per_doc.select("doc", "fills", "left", F.inline("bodies")), markers)
    section = F.concat("start_marker", "managed", "end_marker")
    gaps = F.split(section, BLOCK)
    raw = F.regexp_extract_all(section, F.lit(BLOCK), F.lit(1))

    def piece(gap: Column, i: Column) -> Column:
        fill = F.get("fills", i)
        filled = F.concat(F.lit("\n"), fill["content"], F.lit("\n"))
        block = F.concat(F.lit(BLOCK_OPEN), F.when(fill["filled"], filled).otherwise(F.get(raw, i)), F.lit(BLOCK_CLOSE))
        return F.concat(gap, F.when(i < F.size(raw), block).otherwise(F.lit("")))

    rebuilt = F.array_join(F.transform(gaps, piece), "")
    homeless = F.flatten(F.transform("left", lambda q: q["orphans"]))
    appendix = F.concat(F.lit(ORPHAN_HEAD), F.array_join(F.transform(homeless, _orphan_text), "\n"))
    df = df.withColumn("rebuilt", rebuilt).withColumn("appendix", F.when(F.size("left") > 0, appendix))
    open_section = F.substring(F.col("rebuilt"), F.lit(1), F.length("rebuilt") - F.length("end_marker"))
    closed = F.concat(without_tail(open_section), F.lit("\n\n"), F.col("appendix"), F.lit("\n"), F.col("end_marker"))
    managed = F.when(F.col("appendix").isNull(), F.col("rebuilt")).otherwise(closed)
    homeless_note = F.concat(without_tail(F.col("body")), F.lit("\n\n"), F.col("appendix"), F.lit("\n"))
    body = (
        F.when(F.col("doc").isNull(), F.col("body"))
        .when(F.col("managed").isNull(), F.coalesce(homeless_note, F.col("body")))
        .otherwise(F.concat("before", managed, "after"))
    )
    return df.select("doc", body.alias("body"))


def note_actions(results: DataFrame, overwrite: bool = False) -> DataFrame:
    """What happens to each document's note, the warnings it gets and the error the run reports.

    ``results (doc, name, doc_type, n_highlights, n_rendered, n_drawings, extract_error, render_failed, has_note,
    warnings)``; ``n_rendered`` counts highlights the page renderer added.
    """
    c = F.col
    paper = c("doc_type") != "notebook"
    shown = c("n_highlights") + c("n_rendered")
    failed = c("extract_error").isNotNull()
    action = (
        F.when(failed & (c("n_highlights") == 0) & paper, "fail_extraction")
        .when(c("render_failed") & c("has_note"), "keep_existing_render_failed")
        .when(c("render_failed") & (shown == 0), "fail_render")
        .when((shown == 0) & (c("n_drawings") == 0) & paper & ~c("has_note"), "skip_empty")
        .when(c("has_note") & F.lit(not overwrite), "merge")
        .otherwise("create")
    )
    none = F.array().cast("array<string>")
    partial = F.when(failed & (c("n_highlights") > 0), F.array(F.concat(F.lit("Partial extraction: "), c("extract_error")))).otherwise(none)
    unrendered = F.when(c("render_failed"), F.array(F.lit("Page rendering failed; drawings may be missing this run."))).otherwise(none)
    all_warnings = F.when(c("action") == "fail_extraction", c("warnings")).otherwise(F.concat(partial, c("warnings"), unrendered))
    kept = F.when(c("has_note"), "existing note left unchanged.").otherwise("drawings may be missing.")
    error = F.when(c("action") == "fail_extraction", F.concat(c("name"), F.lit(": "), c("extract_error"))).when(
        c("render_failed"), F.concat(c("name"), F.lit(": page rendering failed; "), kept)
    )
    return results.withColumn("action", action).select("doc", "action", all_warnings.alias("warnings"), error.alias("error"))


# --- names and handwriting -------------------------------------------------------------------------------------------


def stable_names(docs: DataFrame, registry: DataFrame) -> DataFrame:
    """(uuid, base_name): the name of the note a document has, else its own, with an ending where names collide.

    A clean name is free when no note in scope has it and no other new document wants it; otherwise all new ones
    that want it get `` (uuid8)``.
    """
    named = docs.select("uuid", "visible_name", F.lower("uuid").alias("k")).join(
        registry.select(F.col("uuid").alias("k"), F.col("base_name").alias("has")), "k", "left"
    )
    wanted = named.select("uuid", "has", F.coalesce("has", note_name(F.col("visible_name"))).alias("base"))
    names = wanted.groupBy("base").agg(F.count_if(F.col("has").isNull()).alias("new"), F.count("has").alias("used"))
    ending = F.concat(F.lit(" ("), F.substring("uuid", 1, 8), F.lit(")"))
    collides = F.col("has").isNull() & ((F.col("used") > 0) | (F.col("new") > 1))
    name = F.when(collides, F.concat("base", ending)).otherwise(F.col("base"))
    return wanted.join(names, "base").select("uuid", name.alias("base_name"))


def assemble_ocr_text(words: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Recognised words to lines to page text, with the mean confidence and a flag when it is low."""
    word = trimmed(F.col("word"))
    counts = (word != "") & (F.col("conf") >= 0)
    line_key = [*DOC_PAGE, "block", "par", "line"]
    lines = words.groupBy(*line_key).agg(
        F.array_sort(F.collect_list(F.when(counts, F.struct(F.col("pos"), word.alias("w"))))).alias("ws"),
        F.coalesce(F.sum(F.when(counts, F.col("conf"))), F.lit(0.0)).alias("conf"),
        F.count_if(counts).alias("n"),
    )
    text = F.array_join("ws.w", " ")
    pages = lines.groupBy(*DOC_PAGE).agg(
        F.array_sort(F.collect_list(F.when(F.col("n") > 0, F.struct("block", "par", "line", text.alias("t"))))).alias("ls"),
        F.sum("conf").alias("conf"),
        F.sum("n").alias("n"),
    )
    confidence = F.when(F.col("n") > 0, F.col("conf") / F.col("n")).otherwise(F.lit(0.0))
    full = pages.select(*DOC_PAGE, F.array_join("ls.t", "\n").alias("text"), confidence.alias("confidence"))
    return full.withColumn("is_low", (F.col("text") != "") & (F.col("confidence") < min_confidence))
