"""Notes from a user's template.

The template is cut once, on the driver, into texts, variables and blocks; the result is one Column that Catalyst
plans with the rest of the query.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import day, page_link, quoted
from marginalia.operators.notes import MARKERS, OCR_HEAD, Markers, group_by_page

# Texts of empty blocks.
NO_PAGES = "_No highlights or annotations found._"
NO_HIGHLIGHTS = "_No highlights found._"

TAG = re.compile(
    r"\{\{#each\s+pages\}\}(?P<pages>.*?)\{\{/each_pages\}\}"
    r"|\{\{#each\s+highlights\}\}(?P<highlights>.*?)\{\{/each\}\}"
    r"|\{\{#if\s+(?P<test>\w+)\}\}(?P<body>.*?)\{\{/if\}\}"
    r"|\{\{(?P<variable>\w+)\}\}",
    re.DOTALL,
)


def template_warnings(template: str, markers: tuple[Markers, ...] = MARKERS) -> list[str]:
    """What a template lacks for notes that can be kept up to date."""
    missing = []
    if "{{title}}" not in template:
        missing.append("no {{title}}: notes will have no title")
    if "{{#each highlights}}" not in template:
        missing.append("no {{#each highlights}}: highlights will be left out")
    if not any(f"{m.name}:start" in template for m in markers):
        missing.append("no start and end markers: later runs cannot tell which part is theirs")
    return missing


def neutralised(text: Column) -> Column:
    """Recognised text must not pass for template variables."""
    return F.replace(F.replace(text, F.lit("{{"), F.lit("{ {")), F.lit("}}"), F.lit("} }"))


def _compiled(template: str, scope: dict, tests: dict, blocks: dict) -> Column:
    """Template text as a Column.  ``scope`` has variables, ``tests`` conditions, ``blocks`` repeated parts."""
    parts, at = [], 0
    for m in TAG.finditer(template):
        parts.append(F.lit(template[at : m.start()]))
        at = m.end()
        if m["pages"] is not None:
            parts.append(blocks["pages"](m["pages"]) if "pages" in blocks else F.lit(m[0]))
        elif m["highlights"] is not None:
            parts.append(blocks["highlights"](m["highlights"]))
        elif m["test"] is not None:
            body = _compiled(m["body"], scope, tests, blocks)
            parts.append(F.when(tests.get(m["test"], F.lit(False)), body).otherwise(F.lit("")))
        else:
            parts.append(scope.get(m["variable"], F.lit(m[0])))
    parts.append(F.lit(template[at:]))
    return F.concat(*parts)


def render_with_template(
    docs: DataFrame,
    highlights: DataFrame,
    drawings: DataFrame,
    ocr: DataFrame,
    template: str,
    author: str = "Unknown",
    link_style: str = "pdfpp",
    colours: bool = True,
) -> DataFrame:
    """A highlight's ``created_at`` is its own day if ``highlights`` has one, else the document's.

    Gives (doc, body, highlight_count) for ``docs (doc, uuid, name, doc_type, last_modified, source_label, pdf_name, tags)``."""
    texts = F.coalesce("ocr_text", F.lit(""))
    fields = ["text", "color", *[c for c in ("created_at",) if c in highlights.columns]]
    pages = group_by_page(highlights, drawings, ocr).withColumn("ocr_text", neutralised(texts))
    page = F.struct("page", "highlights", F.coalesce("filename", F.lit("")).alias("filename"), "ocr_text")
    per_doc = pages.groupBy("doc").agg(F.array_sort(F.collect_list(page)).alias("pages"))
    page_type = per_doc.schema["pages"].dataType.simpleString()
    df = docs.join(per_doc, "doc", "left").withColumn("pages", F.coalesce("pages", F.array().cast(page_type)))
    flat = F.flatten(
        F.transform("pages", lambda p: F.transform(p["highlights"], lambda h: F.struct(p["page"].alias("page"), *[h[f].alias(f) for f in fields])))
    )
    df = df.withColumn("flat", flat).withColumn("highlight_count", F.size("flat"))
    c = F.col
    dated = day(c("last_modified"))

    def tagged(before: str, between: str) -> Column:
        return F.array_join(F.transform("tags", lambda t: F.concat(F.lit(before), t)), between)

    def callout(text: Column) -> Column:
        return F.when(text != "", F.concat(F.lit(OCR_HEAD), quoted(text))).otherwise(F.lit(""))

    def drawn(p: Column) -> Column:
        image = F.when(p["filename"] != "", F.concat(F.lit("![["), p["filename"], F.lit("|500]]\n"))).otherwise(F.lit(""))
        text = F.when(p["ocr_text"] != "", F.concat(callout(p["ocr_text"]), F.lit("\n"))).otherwise(F.lit(""))
        return F.concat(F.lit("**Page "), p["page"].cast("string"), F.lit(":**\n"), image, text)

    shown = F.filter("pages", lambda p: (p["filename"] != "") | (p["ocr_text"] != ""))
    scope = {
        "title": c("name"),
        "author": F.lit(author),
        "date": dated,
        "source_pdf": c("pdf_name"),
        "source_type": F.when(c("doc_type") == "notebook", F.lit("notebook")).otherwise(F.lit("pdf")),
        "uuid": c("uuid"),
        "highlight_count": c("highlight_count").cast("string"),
        "source": F.coalesce("source_label", F.lit("")),
        "annotations": F.array_join(F.transform(shown, drawn), "\n"),
        "tags_yaml": F.when(F.size("tags") == 0, F.lit("[]")).otherwise(tagged("  - ", "\n")),
        "tags_inline": tagged("", ", "),
        "tags_hashtags": tagged("#", " "),
    }
    tests = {name: value != "" for name, value in scope.items()}
    tests.update(
        highlights=c("highlight_count") > 0,
        highlight_count=c("highlight_count") > 0,
        author=F.lit(author not in ("", "Unknown")),
        tags=F.size("tags") > 0,
    )

    def highlight_scope(h: Column, page_number: Column, index: Column) -> dict:
        colour = F.coalesce(h["color"], F.lit("yellow")) if colours else F.lit("")
        return {
            "text": h["text"],
            "page": page_number.cast("string"),
            "color": colour,
            "pdf_link": page_link(c("pdf_name"), page_number, link_style),
            "created_at": F.coalesce(day(h["created_at"]), dated) if "created_at" in fields else dated,
            "index": (index + 1).cast("string"),
        }

    def flat_block(body: str) -> Column:
        lines = F.transform("flat", lambda h, i: _compiled(body, {**scope, **highlight_scope(h, h["page"], i)}, tests, {}))
        return F.when(F.size("flat") == 0, F.lit(NO_HIGHLIGHTS)).otherwise(F.array_join(lines, "\n"))

    def page_text(body: str, p: Column) -> Column:
        own = {
            "page_number": p["page"].cast("string"),
            "annotation": p["filename"],
            "ocr": p["ocr_text"],
            "ocr_callout": callout(p["ocr_text"]),
        }
        page_scope = {**scope, **own}
        page_tests = {**tests, "annotation": p["filename"] != "", "ocr": p["ocr_text"] != "", "ocr_callout": p["ocr_text"] != ""}

        def nested(inner: str) -> Column:
            lines = F.transform(
                p["highlights"], lambda h, i: _compiled(inner, {**page_scope, **highlight_scope(h, p["page"], i)}, page_tests, {})
            )
            return F.array_join(lines, "\n")

        return _compiled(body, page_scope, page_tests, {"highlights": nested})

    def page_block(body: str) -> Column:
        lines = F.transform("pages", lambda p: page_text(body, p))
        return F.when(F.size("pages") == 0, F.lit(NO_PAGES)).otherwise(F.array_join(lines, "\n"))

    body = _compiled(template, scope, tests, {"pages": page_block, "highlights": flat_block})
    return df.select("doc", F.regexp_replace(body, "\\n{3,}", "\n\n").alias("body"), "highlight_count")
