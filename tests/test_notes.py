"""Note sections, typed blocks, merging, names, templates, handwriting."""

import pytest
from pyspark.sql import functions as F

from marginalia.functions import text
from marginalia.operators import notes, template
from marginalia.operators.review import with_highlight_id

START, END = notes.MARKERS[0].start, notes.MARKERS[0].end
OLD_START, OLD_END = notes.MARKERS[1].start, notes.MARKERS[1].end


def bodies(spark, *texts):
    return spark.createDataFrame([(str(i), b) for i, b in enumerate(texts)], "doc string, body string")


def parsed(spark, body, **options):
    return [(r.text, r.page) for r in notes.parse_highlights(bodies(spark, body), **options).orderBy("pos").collect()]


def test_parse(spark):
    two = f"x\n{OLD_START}\n### Page 1\n\n> first\n> -- [[p.pdf#page=1|Page 1]]\n\nplain\n> second\n> -- [[p.pdf#page3|Page 3]]\n{OLD_END}\n> out\n> -- [[p#page=9|x]]"
    assert parsed(spark, two) == [("first", 1), ("second", 3)]
    assert parsed(spark, f"{START}\n> Line one\n> Line two\n> -- [[p.pdf#page=2|Page 2]]\n{END}") == [("Line one\nLine two", 2)]
    assert parsed(spark, "> q\n> -- [[p.pdf#page=2|Page 2]]") == []
    assert parsed(spark, f"{START}\nnothing quoted\n{END}") == []
    assert parsed(spark, f"{START}\n> \n> -- [[p.pdf#page=2|Page 2]]\n> open end\n{END}") == []
    foreign = notes.Markers("another-tool")
    assert parsed(spark, f"{foreign.start}\n> a\n> -- [[p#page=4|x]]\n{foreign.end}", markers=(*notes.MARKERS, foreign)) == [("a", 4)]


def block(content=""):
    return f"<!-- notes -->\n{content}\n<!-- /notes -->"


def note(*parts, start=START, end=END):
    return "head\n" + "\n".join([start, *parts, end]) + "\ntail"


def preserve(spark, old, new):
    pairs = spark.createDataFrame([("d", old, new)], "doc string, old_body string, body string")
    return notes.preserve_typed_notes(pairs).first().body


Q1, Q2 = "> quote one\n> -- [[p#page=1|Page 1]]", "> quote two\n> -- [[p#page=2|Page 2]]"


def test_typed_notes_follow_their_quote(spark):
    merged = preserve(spark, note(Q1, block("mine")), note(Q2, block(), "", Q1, block()))
    assert merged == note(Q2, block(), "", Q1, block("mine"))
    assert preserve(spark, note(Q1, block("mine")), merged) == merged


def test_image_hash_and_size_do_not_matter(spark):
    merged = preserve(spark, note("![[A_p3_a4af.png|900]]", block("pic")), note("![[A_p3_b2c1.png|500]]", block()))
    assert merged == note("![[A_p3_b2c1.png|500]]", block("pic"))


def test_notes_without_a_place_are_kept(spark):
    old = note(Q1, block("lost"), "", Q2, block("kept"))
    merged = preserve(spark, old, note(Q2, block()))
    assert "kept" in merged and "**Originally under:** `> quote one`" in merged
    assert merged.index("lost") < merged.index(END)
    assert preserve(spark, merged, note(Q2, block())).count("lost") == 1
    no_section = preserve(spark, old, "fresh without section  \n")
    assert no_section.startswith("fresh without section\n\n> [!warning] Preserved notes") and "lost" in no_section and "kept" in no_section


def test_same_anchors_fill_in_order(spark):
    old = note(Q1, block("a"), "", Q1, block("b"), "", Q1, block("c"))
    merged = preserve(spark, old, note(Q1, block(), "", Q1, block()))
    assert merged.index("a\n") < merged.index("b\n") < merged.index("Preserved notes") < merged.index("\nc\n")


def test_mixed_markers_and_text_beside_a_block(spark):
    old = note(Q1, block("x"), start=OLD_START, end=OLD_END)
    assert preserve(spark, old, note(Q1, block())) == note(Q1, block("x"))
    beside = f"{START}\n{Q1}\n{block('one')} and more\n{block('two')}\n{END}"
    anchors = {r.content: r.anchor_text for r in notes.anchor_blocks(bodies(spark, beside)).collect()}
    assert anchors["one"] == Q1
    assert anchors["two"] == "<!-- /notes --> and more" or anchors["two"].endswith("<!-- /notes --> and more")


def test_nothing_is_lost(spark):
    quotes = [f"> q{i % 4}\n> -- [[p#page={i % 4}|x]]" for i in range(9)]
    old = note(*[f"{q}\n{block(f'note-{i}')}\n" for i, q in enumerate(quotes)])
    for keep in (0, 3, 9):
        merged = preserve(spark, old, note(*[f"{q}\n{block()}\n" for q in quotes[:keep]]))
        assert all(merged.count(f"note-{i}\n") == 1 for i in range(9))


def test_merge(spark):
    existing = bodies(spark, f"---\nhighlight_count: 2\n---\nmy text\n{START}\nold\n{END}\nafter", "no section \n\n", )
    fresh = spark.createDataFrame([(str(i), "fresh", f"{START}\nnew\n{END}", 7) for i in range(3)], "doc string, body string, section string, highlight_count bigint")
    merged = {r.doc: r.body for r in notes.merge_notes(existing, fresh).collect()}
    assert merged["0"] == f"---\nhighlight_count: 7\n---\nmy text\n{START}\nnew\n{END}\nafter"
    assert merged["1"] == f"no section\n\n{START}\nnew\n{END}\n"
    assert merged["2"] == "fresh"
    assert {r.body for r in notes.merge_notes(existing, fresh, overwrite=True).collect()} == {"fresh"}


def section(spark, highlights, drawings=(), ocr=(), tags=None, **options):
    docs = spark.createDataFrame([("d", "p.pdf", False)], "doc string, pdf_name string, is_notebook boolean")
    h = spark.createDataFrame([("d", *x) for x in highlights], "doc string, page int, seq bigint, text string, color string")
    d = spark.createDataFrame([("d", *x) for x in drawings], "doc string, page int, filename string")
    o = spark.createDataFrame([("d", *x) for x in ocr], "doc string, page int, ocr_text string")
    t = spark.createDataFrame([("d", *x) for x in tags], "doc string, page int, tags array<string>") if tags else None
    return notes.render_section(docs, h, d, o, t, **options).first()


def test_section(spark):
    row = section(spark, [(2, 1, "b\nc", "pink"), (1, 0, "a", "yellow")], [(3, "d_p3.png")], [(3, "hand\nwritten")], [(1, ["x", "y"])])
    assert row.highlight_count == 2
    assert row.section == (
        f"{START}\n## Highlights\n\n### Page 1  #x #y\n\n> a\n> -- [[p.pdf#page=1|Page 1]]\n\n"
        "### Page 2\n\n> b\n> c\n> -- [[p.pdf#page=2|Page 2]]\n<!-- highlight-color: pink -->\n\n"
        f"### Page 3\n\n![[d_p3.png|500]]\n\n> [!note]- Handwriting (OCR)\n> hand\n> written\n\n{END}"
    )
    flat = section(spark, [(1, 0, "a", "pink")], grouped=False, colours=False, link_style="none").section
    assert flat == f"{START}\n## Highlights\n\n> a\n> -- Page 1\n\n{END}"
    assert notes.EMPTY_SECTION in section(spark, []).section


def test_actions(spark):
    schema = "doc string, name string, doc_type string, n_highlights int, n_rendered int, n_drawings int, extract_error string, render_failed boolean, has_note boolean, warnings array<string>"
    cases = {
        "merge": ("pdf", 1, 0, 0, None, False, True),
        "create": ("pdf", 1, 0, 0, None, False, False),
        "fail_extraction": ("pdf", 0, 0, 0, "boom", False, True),
        "keep_existing_render_failed": ("notebook", 0, 0, 0, None, True, True),
        "fail_render": ("pdf", 0, 0, 0, None, True, False),
        "skip_empty": ("pdf", 0, 0, 0, None, False, False),
        "partial": ("pdf", 2, 0, 0, "boom", False, False),
        "cleared": ("pdf", 0, 0, 0, None, False, True),
    }
    df = spark.createDataFrame([(k, k, *v, []) for k, v in cases.items()], schema)
    found = {r.doc: r for r in notes.note_actions(df).collect()}
    expected = {**{k: k for k in cases}, "partial": "create", "cleared": "merge"}
    assert {k: r.action for k, r in found.items()} == expected
    assert found["partial"].warnings == ["Partial extraction: boom"] and found["fail_extraction"].error == "fail_extraction: boom"
    assert found["keep_existing_render_failed"].error.endswith("existing note left unchanged.")
    assert {r.action for r in notes.note_actions(df.filter("doc = 'merge'"), overwrite=True).collect()} == {"create"}


def test_names(spark):
    def named(docs, registry=()):
        d = spark.createDataFrame(list(docs), "uuid string, visible_name string")
        r = spark.createDataFrame(list(registry), "uuid string, base_name string")
        return {x.uuid: x.base_name for x in notes.stable_names(d, r).collect()}

    assert named([("aaaaaaaa-1", "Report")]) == {"aaaaaaaa-1": "Report"}
    assert named([("aaaaaaaa-1", "Quick sheets"), ("bbbbbbbb-2", "Quick sheets")]) == {"aaaaaaaa-1": "Quick sheets (aaaaaaaa)", "bbbbbbbb-2": "Quick sheets (bbbbbbbb)"}
    assert named([("a1111111", "Report: 2024"), ("b2222222", "Report 2024.pdf")]) == {"a1111111": "Report 2024 (a1111111)", "b2222222": "Report 2024 (b2222222)"}
    assert named([("a", "New name"), ("b", "X")], [("a", "Kept")]) == {"a": "Kept", "b": "X"}
    assert named([("a1111111", "S"), ("b2222222", "S")], [("a1111111", "S (a1111111)")])["b2222222"] == "S"
    assert named([("a1111111", "S"), ("b2222222", "S")], [("a1111111", "S")])["b2222222"] == "S (b2222222)"
    assert named([("a", ' <>:"/\\|?*\t.pdf ')]) == {"a": ".pdf"}
    assert named([("a", "???.PDF")]) == {"a": "Untitled"}


def test_blocks_travel_without_their_passages(spark):
    def rows_moved(length):
        passage = "> " + "q" * length
        old = f"<!-- marginalia:start -->\n{passage}\n<!-- notes -->\nmine\n<!-- /notes -->\n<!-- marginalia:end -->"
        pairs = spark.createDataFrame([(1, old, "<!-- marginalia:start -->\n<!-- marginalia:end -->")], "doc bigint, old_body string, body string")
        merged = notes.preserve_typed_notes(pairs)
        body = merged.collect()[0].body
        assert body.count("mine") == 1 and "`> " + "q" * min(length, 98) in body
        plan = merged._jdf.queryExecution().executedPlan()
        return plan.toString()

    assert "sha2" in rows_moved(300)


@pytest.mark.parametrize("line", ["", " \t", "\u00a0", "<!-- notes -->", "  <!--  /notes-->\u3000", "<!-- marginalia-v0:end -->", "x <!-- notes -->", "<!-- notes --> x", "> q", "<!-- other -->"])
def test_lines_that_stop_an_anchor(spark, line):
    stops = line.strip("\u00a0\u3000 \t") in ("", "<!-- notes -->", "<!--  /notes-->", "<!-- marginalia-v0:end -->")
    df = spark.createDataFrame([(f"above\n{line}\nlast",)], "t string")
    assert df.select(notes._lines_above(F.col("t"), notes.MARKERS)).first()[0] == ("last" if stops else f"above\n{line}\nlast")


def test_anchor_keys_ignore_blanks(spark):
    texts = ["a b", " a  b ", "a\tb", "A\u00a0\u3000 b\n", "a \n b", "a\ufeffb"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(notes.anchor_key(F.col("t"))).collect()] == ["a b"] * len(texts)


def djb2(s):
    h = 5381
    data = s.encode("utf-16-le")
    for i in range(0, len(data), 2):
        h = (h * 33 + int.from_bytes(data[i : i + 2], "little")) % 2**32
    digits = ""
    while h:
        h, d = divmod(h, 36)
        digits = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + digits
    return digits


def test_highlight_id(spark):
    texts = ["", "a", "héllo wörld", "astral 😀 text", "日本語"]
    df = spark.createDataFrame([("u", 7, t) for t in texts], "uuid string, page int, text string")
    assert {r.text: r.id for r in with_highlight_id(df).collect()} == {t: f"u:p7:{djb2(t)}" for t in texts}


def test_long_texts_are_hashed_without_a_loop_over_letters(spark):
    texts = ["é😀z" * n for n in (16_384, 21_846, 50_000)] + ["a" * 65_535, "b" * 65_536, "c" * 65_537, None]
    named = with_highlight_id(spark.createDataFrame([("u", 7, t) for t in texts], "uuid string, page int, text string"))
    assert {r.text: r.id for r in named.collect()} == {t: t and f"u:p7:{djb2(t)}" for t in texts}
    assert "lambda" not in named._jdf.queryExecution().toString()


def test_text_helpers(spark):
    df = spark.range(1).select(
        text.yaml_escaped(F.lit('a"b\\c\nd')).alias("yaml"),
        text.shortened(F.lit("x" * 101)).alias("short"),
        text.page_image(F.lit("B"), F.lit(3), F.lit(0x1A4AF).cast("bigint")).alias("image"),
        text.image_name(F.lit(" a.epub.pdf ")).alias("name"),
        text.relative_time(F.lit(1700000000), F.lit(1700000000000 + 90 * 60000), "long").alias("ago"),
        text.relative_time(F.lit(1700000000000), F.lit(1700000000000 + 40 * 86400000), "long").alias("date"),
    )
    assert tuple(df.first()) == ('a\\"b\\\\c\\nd', "x" * 100 + "…", "B_p3_a4af.png", "a", "1h ago", "Nov 14")


def test_header(spark):
    schema = "doc string, uuid string, name string, doc_type string, last_modified bigint, source_label string, tags array<string>, warnings array<string>"
    docs = spark.createDataFrame([("d", "u", 'A "q".pdf', "pdf", 1700000000000, "Home", ["x", "y", "x"], ["w"])], schema)
    sections = spark.createDataFrame([("d", "SECTION", 2)], "doc string, section string, highlight_count bigint")
    body = notes.render_notes(docs, sections).first().body
    assert body == (
        '---\ntitle: "A \\"q\\""\nsource_pdf: "[[A \\"q\\".pdf]]"\nsource_type: pdf\ndate_highlighted: 2023-11-14\nhighlight_count: 2\nremarkable_uuid: u\n'
        f'source: "Home"\ntags:\n  - x\n  - y\n---\n\n{notes.KEEP_OUT}\n\nSECTION\n\n## Extraction Notes\n\n- w\n'
    )


@pytest.mark.parametrize(
    "source, expected",
    [
        ("{{title}}|{{tags_inline}}|{{tags_hashtags}}|{{unknown}}", "T|a, b|#a #b|{{unknown}}"),
        ("{{#each highlights}}{{index}}:{{text}}@{{page}} {{/each}}", "1:one@1 \n2:two@2 "),
        ("{{#if source}}yes{{/if}}{{#if author}}no{{/if}}{{#if tags}}tags{{/if}}", "tags"),
        ("{{#each pages}}p{{page_number}}{{#each highlights}} {{text}}{{/each}}{{#if annotation}} [{{annotation}}]{{/if}}{{#if ocr}} {{ocr}}{{/if}}{{/each_pages}}", "p1 one\np2 two [i.png] { {title} }"),
        ("a\n\n\n\nb {{highlight_count}}", "a\n\nb 2"),
        ("{{tags_yaml}}", "  - a\n  - b"),
    ],
)
def test_template(spark, source, expected):
    docs = spark.createDataFrame([("d", "u", "T", "pdf", 86400000, None, "p.pdf", ["a", "b"])], "doc string, uuid string, name string, doc_type string, last_modified bigint, source_label string, pdf_name string, tags array<string>")
    h = spark.createDataFrame([("d", 1, 0, "one", None), ("d", 2, 1, "two", "pink")], "doc string, page int, seq bigint, text string, color string")
    d = spark.createDataFrame([("d", 2, "i.png")], "doc string, page int, filename string")
    o = spark.createDataFrame([("d", 2, "{{title}}")], "doc string, page int, ocr_text string")
    assert template.render_with_template(docs, h, d, o, source).first().body == expected


def test_template_checks():
    assert len(template.template_warnings("nothing")) == 3
    assert template.template_warnings("{{title}}{{#each highlights}}{{/each}}" + START) == []


def test_ocr(spark):
    rows = [(1, 0, 0, 0, "Hello", 90.0), (1, 0, 0, 1, "world", 80.0), (1, 0, 1, 0, "next", 10.0), (1, 0, 1, 1, " ", 95.0), (1, 0, 1, 2, "gone", -1.0), (2, 0, 0, 0, "faint", 20.0), (3, 0, 0, 0, "", 5.0)]
    words = spark.createDataFrame([("d", p, b, 0, ln, pos, w, c) for p, b, ln, pos, w, c in rows], "doc string, page int, block int, par int, line int, pos int, word string, conf double")
    found = {r.page: tuple(r)[2:] for r in notes.assemble_ocr_text(words).collect()}
    assert found == {1: ("Hello world\nnext", 60.0, False), 2: ("faint", 20.0, True), 3: ("", 0.0, False)}


def test_template_has_the_highlights_own_day(spark):
    docs = spark.createDataFrame([("d", "u", "T", "pdf", 86400000, None, "p.pdf", [])], "doc string, uuid string, name string, doc_type string, last_modified bigint, source_label string, pdf_name string, tags array<string>")
    h = spark.createDataFrame([("d", 1, 0, "one", None, 3 * 86400000), ("d", 2, 1, "two", "pink", None)], "doc string, page int, seq bigint, text string, color string, created_at bigint")
    d = spark.createDataFrame([], "doc string, page int, filename string")
    o = spark.createDataFrame([], "doc string, page int, ocr_text string")
    body = template.render_with_template(docs, h, d, o, "{{#each highlights}}{{created_at}};{{/each}}").first().body
    assert body.split("\n") == ["1970-01-04;", "1970-01-02;"]


@pytest.mark.parametrize("overwrite", [False, True])
def test_merging_deals_bodies_once_and_keeps_none(spark, overwrite):
    old = [(i, f"{START}\n{Q1}\n{block(f'mine {i}')}\n{END}") for i in range(4)] + [(None, f"{START}\n{Q1}\n{block('no one')}\n{END}")]
    section = f"{START}\n{Q1}\n{block()}\n{END}"
    existing = spark.createDataFrame(old, "doc int, body string")
    fresh = spark.createDataFrame([(i, "new\n" + section, section, 1) for i in (0, 1, 2, 5, None)], "doc int, body string, section string, highlight_count bigint")
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        merged = notes.merge_notes(existing, fresh, overwrite)
        plan = merged._jdf.queryExecution().executedPlan().toString()
        found = {r.doc: r.body for r in merged.collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert plan.count("Exchange") == 2 and "parquet" not in plan.lower()
    assert found == {i: f"{'new' + chr(10) if overwrite else ''}{START}\n{Q1}\n{block(f'mine {i}')}\n{END}" for i in range(3)} | {i: "new\n" + section for i in (5, None)}


def test_repeated_notes_share_their_blocks(spark):
    old, new = note(Q1, block("a")), note(Q1, block())
    pairs = spark.createDataFrame([(1, old, new), (1, old, new), (None, old, new), (2, None, new), (3, old, None)], "doc int, old_body string, body string")
    found = sorted(((r.doc, r.body) for r in notes.preserve_typed_notes(pairs).collect()), key=str)
    assert found == sorted([(1, note(Q1, block("a")))] * 2 + [(None, new), (2, new), (3, None)], key=str)
