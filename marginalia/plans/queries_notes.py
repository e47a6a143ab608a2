"""Queries over notes and reviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.functions import text
from marginalia.operators import notes, review, template
from marginalia.plans.registry import query, trimmed_sql
from marginalia.session import shared_folder
from marginalia.sources import store

NL = "chr(10)"


def split_sql(source: str, columns: str = "doc, body") -> str:
    """CTE ``split`` with the managed section of ``source (doc, body)``."""
    s = [f"instr(body, '<!-- {n}:start -->')" for n in ("marginalia", "marginalia-v0")]
    e = [f"instr(body, '<!-- {n}:end -->')" for n in ("marginalia", "marginalia-v0")]
    return f"""
    found_at AS (SELECT {columns}, CASE WHEN {s[0]} > 0 THEN {s[0]} ELSE {s[1]} END AS s, CASE WHEN {s[0]} > 0 THEN 25 ELSE 28 END AS sn,
        CASE WHEN {e[0]} > 0 THEN {e[0]} ELSE {e[1]} END AS e, CASE WHEN {e[0]} > 0 THEN 23 ELSE 26 END AS en FROM {source}),
    split AS (SELECT {columns}, CASE WHEN s > 0 AND e >= s + sn THEN substring(body, 1, s - 1) END AS before,
        CASE WHEN s > 0 AND e >= s + sn THEN substring(body, s + sn, e - s - sn) END AS managed,
        CASE WHEN s > 0 AND e >= s + sn THEN substring(body, e + en) END AS after FROM found_at)"""


LINES = """,
    lines AS (SELECT doc, unnest(string_split(managed, chr(10))) AS line, unnest(range(len(string_split(managed, chr(10))))) AS i FROM split WHERE managed IS NOT NULL),
    quotes AS (SELECT doc, i, substring(line, 3) AS q, regexp_extract(substring(line, 3), '^--[ \\t]+.*#page=?([0-9]+)', 1) AS page FROM lines WHERE starts_with(line, '> ')),
    islands AS (SELECT *, count(*) FILTER (page <> '') OVER (PARTITION BY doc ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS k FROM quotes),
    """ + f"""
    found AS (SELECT doc, CAST(k AS INTEGER) AS pos, {trimmed_sql(f"string_agg(q, {NL} ORDER BY i) FILTER (page = '')")} AS text, max(CAST(nullif(page, '') AS INTEGER)) AS page
        FROM islands GROUP BY doc, k HAVING max(page) <> '')"""


@query("split_managed_section", "old_notes", split_sql("old_notes"), "SELECT doc, before, managed, after FROM split")
def split_managed_section(t):
    return notes.split_managed_section(t("old_notes")).select("doc", "before", "managed", "after")


@query("parse_highlights", "old_notes", split_sql("old_notes") + LINES, "SELECT doc, pos, text, page FROM found WHERE text <> ''")
def parse_highlights(t):
    return notes.parse_highlights(t("old_notes"))


DJB2 = """CASE WHEN text = '' THEN 5381 ELSE list_reduce(list_transform(flatten(list_transform(string_split(text, ''),
    lambda c: CASE WHEN unicode(c) > 65535 THEN [55296 + (unicode(c) - 65536) // 1024, 56320 + (unicode(c) - 65536) % 1024] ELSE [unicode(c)] END)), lambda u: CAST(u AS BIGINT)),
    lambda h, u: (h * 33 + u) % 4294967296, CAST(5381 AS BIGINT)) END"""


@query(
    "highlight_ids",
    "old_notes",
    split_sql("old_notes") + LINES + f""",
    hashed AS (SELECT doc, page, text, {DJB2} AS h FROM found WHERE text <> '')""",
    "SELECT doc, text, CAST(doc AS VARCHAR) || ':p' || page || ':' || lower(to_base(h, 36)) AS id FROM hashed",
)
def highlight_ids(t):
    parsed = notes.parse_highlights(t("old_notes")).withColumn("uuid", F.col("doc").cast("string"))
    return review.with_highlight_id(parsed).select("doc", "text", "id")


@query(
    "path_hashes",
    "owned_files",
    f"""p AS (SELECT DISTINCT path AS text FROM owned_files), hashed AS (SELECT text, {DJB2} AS h FROM p)""",
    "SELECT text AS path, lower(to_base(h, 16)) AS hash FROM hashed",
)
def path_hashes(t):
    return t("owned_files").select("path").distinct().select("path", text.djb2_hex(F.col("path")).alias("hash"))


@query(
    "note_registry",
    "old_notes",
    "",
    """SELECT regexp_extract(body, 'remarkable_uuid: ([0-9a-f-]{36})', 1) AS uuid, regexp_extract(path, '([^/]*)[.]md$', 1) AS base_name,
        CAST(regexp_extract(body, 'highlight_count: ([0-9]+)', 1) AS BIGINT) AS highlight_count FROM old_notes""",
)
def note_registry(t):
    return store.read_note_registry(t("old_notes"))


PAGES = """
    pages AS (SELECT doc, page, list({'s': seq, 't': text, 'c': color} ORDER BY seq) FILTER (seq IS NOT NULL) AS hs, max(filename) AS filename, max(ocr_text) AS ocr
        FROM (SELECT doc, page, seq, text, color, NULL AS filename, NULL AS ocr_text FROM page_highlights
            UNION ALL SELECT doc, page, NULL, NULL, NULL, filename, NULL FROM drawings
            UNION ALL SELECT doc, page, NULL, NULL, NULL, NULL, ocr_text FROM page_ocr) GROUP BY doc, page)"""


@query(
    "group_by_page",
    "page_highlights drawings page_ocr",
    PAGES,
    "SELECT doc, page, coalesce(array_to_string(list_transform(hs, lambda h: h.s || '=' || h.t), ';'), '') AS highlights, filename, ocr AS ocr_text FROM pages",
)
def group_by_page(t):
    pages = notes.group_by_page(t("page_highlights"), t("drawings"), t("page_ocr"))
    listed = F.transform("highlights", lambda h: F.concat(h["seq"].cast("string"), F.lit("="), h["text"]))
    return pages.withColumn("highlights", F.array_join(listed, ";"))


SECTION = PAGES + """,
    tagged AS (SELECT doc, page, string_agg('#' || tag, ' ' ORDER BY tag) AS tags FROM section_tags GROUP BY doc, page),
    texts AS (SELECT p.doc, p.page, coalesce(len(hs), 0) AS n, '### Page ' || p.page || coalesce('  ' || t.tags, '') || chr(10) || chr(10)
        || coalesce(array_to_string(list_transform(hs, lambda h: '> ' || replace(h.t, chr(10), chr(10) || '> ') || chr(10) || '> -- [[' || d.pdf_name || '#page=' || p.page || '|Page ' || p.page || ']]'
            || CASE WHEN h.c <> 'yellow' THEN chr(10) || '<!-- highlight-color: ' || h.c || ' -->' ELSE '' END || chr(10) || chr(10)), ''), '')
        || coalesce('![[' || filename || '|500]]' || chr(10) || chr(10), '')
        || coalesce('> [!note]- Handwriting (OCR)' || chr(10) || '> ' || replace(ocr, chr(10), chr(10) || '> ') || chr(10) || chr(10), '') AS content
        FROM pages p JOIN section_docs d USING (doc) LEFT JOIN tagged t USING (doc, page)),
    bodies AS (SELECT doc, string_agg(content, '' ORDER BY page) AS content, sum(n) AS n FROM texts GROUP BY doc)"""


@query(
    "render_section",
    "section_docs page_highlights drawings page_ocr section_tags",
    SECTION,
    """SELECT doc, '<!-- marginalia:start -->' || chr(10) || CASE WHEN is_notebook THEN '## Pages' ELSE '## Highlights' END || chr(10) || chr(10)
        || coalesce(content, '_No highlights or annotations found in this document._' || chr(10)) || '<!-- marginalia:end -->' AS section,
        CAST(coalesce(n, 0) AS BIGINT) AS highlight_count FROM section_docs LEFT JOIN bodies USING (doc)""",
)
def render_section(t):
    tags = t("section_tags").groupBy("doc", "page").agg(F.array_sort(F.collect_list("tag")).alias("tags"))
    return notes.render_section(t("section_docs"), t("page_highlights"), t("drawings"), t("page_ocr"), tags)


@query(
    "page_links",
    "section_docs",
    "",
    """SELECT doc, '[[' || pdf_name || '#page' || doc || '|Page ' || doc || ']]' AS obsidian, 'Page ' || doc AS plain FROM section_docs""",
)
def page_links(t):
    link = [text.page_link(F.col("pdf_name"), F.col("doc"), style).alias(name) for style, name in (("obsidian", "obsidian"), ("none", "plain"))]
    return t("section_docs").select("doc", *link)


YAML = "replace(replace(replace({0}, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"'), chr(10), chr(92) || 'n')"


@query(
    "render_notes",
    "note_docs new_sections",
    "",
    f"""SELECT n.doc, '---' || {NL} || 'title: "' || {YAML.format("regexp_replace(name, '(?i)[.](pdf|epub)$', '')")} || '"' || {NL}
        || CASE WHEN doc_type = 'notebook' THEN '' ELSE 'source_pdf: "[[' || {YAML.format("CASE WHEN regexp_matches(name, '(?i)[.]pdf$') THEN name ELSE name || '.pdf' END")} || ']]"' || {NL} END
        || 'source_type: ' || doc_type || {NL} || 'date_highlighted: ' || strftime(make_timestamp(last_modified * 1000), '%Y-%m-%d') || {NL}
        || 'highlight_count: ' || highlight_count || {NL} || 'remarkable_uuid: ' || uuid || {NL}
        || CASE WHEN source_label IS NULL THEN '' ELSE 'source: "' || {YAML.format("source_label")} || '"' || {NL} END
        || CASE WHEN doc_type = 'notebook' THEN '' ELSE 'tags:' || {NL} || '  - ' || lang || {NL} || '  - x' || {NL} END || '---' || {NL} || {NL}
        || '<!-- The part between the start and end comments is written anew on every run; write above or below it. -->' || {NL} || {NL}
        || section || {NL} || CASE WHEN n_chars % 2 = 0 THEN {NL} || '## Extraction Notes' || {NL} || {NL} || '- ' || source || {NL} ELSE '' END AS body
    FROM note_docs n JOIN new_sections s USING (doc)""",
)
def render_notes(t):
    none = F.array().cast("array<string>")
    docs = t("note_docs").withColumns(
        {
            "tags": F.when(F.col("doc_type") == "notebook", none).otherwise(F.array("lang", F.lit("x"), "lang")),
            "warnings": F.when(F.col("n_chars") % 2 == 0, F.array("source")).otherwise(none),
        }
    )
    return notes.render_notes(docs, t("new_sections")).select("doc", "body")


# Blocks of a section: the text between them, and the lines each one hangs on.
_BLOCKS = f"""
    @p0 AS (SELECT doc, string_split(@section, '<!-- notes -->') AS parts FROM @source WHERE managed IS NOT NULL),
    @p1 AS (SELECT doc, unnest(range(1, len(parts))) AS pos, parts FROM @p0),
    @p2 AS (SELECT doc, CAST(pos - 1 AS INTEGER) AS pos, {trimmed_sql("string_split(parts[pos + 1], '<!-- /notes -->')[1]")} AS content,
        string_split(regexp_replace(parts[pos], '[ ' || chr(10) || ']+$', ''), chr(10)) AS lines FROM @p1),
    @p3 AS (SELECT doc, pos, content, lines, list_max(list_prepend(0, list_transform(range(1, len(lines) + 1),
        lambda i: CASE WHEN trim(lines[i]) = '' OR regexp_matches(trim(lines[i]), '^<!-- (/?notes|marginalia(-v0)?:(start|end)) -->$') THEN i ELSE 0 END))) AS stop FROM @p2),
    @p4 AS (SELECT doc, pos, content, array_to_string(lines[stop + 1:], chr(10)) AS anchor FROM @p3),
    @p AS (SELECT doc, pos, content, anchor AS anchor_text, coalesce(nullif(lower({trimmed_sql("regexp_replace(regexp_replace(regexp_replace(anchor, '(?i)_p([0-9]+)_[0-9a-f]+[.](png|svg|jpg|jpeg)', '_p' || chr(92) || '1.' || chr(92) || '2', 'g'), '[|][^]]*[]][]]', ']]', 'g'), '[[:space:]]+', ' ', 'g')")}), ''),
        '__section-start__') AS key FROM @p4)"""

def blocks_sql(p: str, section: str, source: str) -> str:
    return _BLOCKS.replace("@p", p).replace("@section", section).replace("@source", source)


OLD_BLOCKS = split_sql("old_notes") + "," + blocks_sql(p="o", section="'<!-- marginalia:start -->' || managed", source="split")


@query("anchor_blocks", "old_notes", OLD_BLOCKS, "SELECT doc, pos, key, anchor_text, content FROM o")
def anchor_blocks(t):
    return notes.anchor_blocks(t("old_notes"))


CARRY = (
    OLD_BLOCKS
    + ", fresh AS (SELECT doc, section AS managed FROM new_sections),"
    + blocks_sql(p="n", section="managed", source="fresh")
    + """,
    queue AS (SELECT *, row_number() OVER (PARTITION BY doc, key ORDER BY pos) AS k FROM o WHERE content <> ''),
    slots AS (SELECT *, row_number() OVER (PARTITION BY doc, key ORDER BY pos) AS k FROM n)"""
)


@query(
    "carry_notes_forward",
    "old_notes new_sections",
    CARRY,
    """SELECT q.doc, q.key, q.content, s.pos AS slot FROM queue q LEFT JOIN slots s USING (doc, key, k)""",
)
def carry_notes_forward(t):
    fresh = t("new_sections").select("doc", F.col("section").alias("body"))
    carried = notes.carry_notes_forward(notes.anchor_blocks(t("old_notes")), notes.anchor_blocks(fresh))
    placed = carried.select("doc", "key", F.explode("fills").alias("f")).filter("f.filled").select("doc", "key", "f.content", F.col("f.pos").alias("slot"))
    homeless = carried.select("doc", "key", F.explode("orphans").alias("o")).select("doc", "key", "o.content", F.lit(None).cast("int").alias("slot"))
    return placed.unionByName(homeless)


MERGED = (
    CARRY
    + f""",
    filled AS (SELECT s.doc, list(CASE WHEN q.content IS NULL THEN '' ELSE {NL} || q.content || {NL} END ORDER BY s.pos) AS fills,
        list(q.content IS NOT NULL ORDER BY s.pos) AS took FROM slots s LEFT JOIN queue q USING (doc, key, k) GROUP BY s.doc),
    lost AS (SELECT q.doc, string_agg(CASE WHEN q.anchor_text <> '' THEN '**Originally under:** `' || CASE WHEN length(trim(string_split(q.anchor_text, {NL})[1])) > 100
            THEN left(trim(string_split(q.anchor_text, {NL})[1]), 100) || '…' ELSE trim(string_split(q.anchor_text, {NL})[1]) END || '`' || {NL} ELSE '' END
            || '<!-- notes -->' || {NL} || q.content || {NL} || '<!-- /notes -->' || {NL}, {NL} ORDER BY q.pos) AS text
        FROM queue q LEFT JOIN slots s USING (doc, key, k) WHERE s.pos IS NULL GROUP BY q.doc),
    pieces AS (SELECT f.doc, f.highlight_count, f.section, f.body AS fresh_body, old.body AS old_body, split.before, split.managed, split.after, string_split(f.section, '<!-- notes -->') AS parts,
            filled.fills, filled.took, lost.text AS lost
        FROM fresh_notes f LEFT JOIN old_notes old USING (doc) LEFT JOIN split USING (doc) LEFT JOIN filled USING (doc) LEFT JOIN lost USING (doc)),
    rebuilt AS (SELECT *, CASE WHEN managed IS NULL THEN section ELSE parts[1] || array_to_string(list_transform(range(2, len(parts) + 1), lambda i: '<!-- notes -->'
            || CASE WHEN took[i - 1] THEN fills[i - 1] || substring(parts[i], instr(parts[i], '<!-- /notes -->')) ELSE parts[i] END), '') END AS s FROM pieces),
    closed AS (SELECT *, CASE WHEN managed IS NULL OR lost IS NULL THEN s ELSE regexp_replace(left(s, length(s) - 23), '[ ' || {NL} || ']+$', '') || {NL} || {NL}
        || '> [!warning] Preserved notes' || {NL} || '> The passages these notes stood under are gone. The notes stay here until you give them a new place.'
        || {NL} || {NL} || lost || {NL} || '<!-- marginalia:end -->' END AS final FROM rebuilt)"""
)


@query(
    "merge_notes",
    "old_notes new_sections fresh_notes",
    MERGED,
    f"""SELECT doc, CASE WHEN old_body IS NULL THEN fresh_body WHEN managed IS NULL THEN regexp_replace(old_body, '[ ' || {NL} || ']+$', '') || {NL} || {NL} || section || {NL}
        ELSE regexp_replace(before, '(?m)^highlight_count: [0-9]+$', 'highlight_count: ' || highlight_count) || final || after END AS body FROM closed""",
)
def merge_notes(t):
    return notes.merge_notes(t("old_notes").select("doc", "body"), t("fresh_notes"))


@query(
    "overwrite_notes",
    "old_notes new_sections fresh_notes",
    MERGED,
    f"""SELECT doc, CASE WHEN managed IS NULL THEN fresh_body ELSE replace(fresh_body, section, final) END AS body FROM closed""",
)
def overwrite_notes(t):
    return notes.merge_notes(t("old_notes").select("doc", "body"), t("fresh_notes"), overwrite=True)


@query(
    "note_actions",
    "note_inputs",
    f"""a AS (SELECT *, CASE WHEN extract_error IS NOT NULL AND n_highlights = 0 AND doc_type <> 'notebook' THEN 'fail_extraction'
        WHEN render_failed AND has_note THEN 'keep_existing_render_failed' WHEN render_failed AND n_highlights + n_rendered = 0 THEN 'fail_render'
        WHEN n_highlights + n_rendered = 0 AND n_drawings = 0 AND doc_type <> 'notebook' AND NOT has_note THEN 'skip_empty'
        WHEN has_note THEN 'merge' ELSE 'create' END AS action FROM note_inputs)""",
    """SELECT doc, action, concat_ws('; ', CASE WHEN action <> 'fail_extraction' AND extract_error IS NOT NULL AND n_highlights > 0 THEN 'Partial extraction: ' || extract_error END, 'w' || doc,
        CASE WHEN action <> 'fail_extraction' AND render_failed THEN 'Page rendering failed; drawings may be missing this run.' END) AS warnings,
        CASE WHEN action = 'fail_extraction' THEN name || ': ' || extract_error WHEN render_failed THEN name || ': page rendering failed; '
            || CASE WHEN has_note THEN 'existing note left unchanged.' ELSE 'drawings may be missing.' END END AS error FROM a""",
)
def note_actions(t):
    results = t("note_inputs").withColumn("warnings", F.array(F.concat(F.lit("w"), F.col("doc").cast("string"))))
    return notes.note_actions(results).withColumn("warnings", F.array_join("warnings", "; "))


@query(
    "warning_callouts",
    "old_notes",
    "",
    f"""SELECT doc, CASE WHEN doc % 3 = 0 THEN '> [!warning] Extraction warnings' || {NL} || '> - a' || {NL} || '> - ' || doc || {NL} || {NL} || body ELSE body END AS body FROM old_notes""",
)
def warning_callouts(t):
    warnings = F.when(F.col("doc") % 3 == 0, F.array(F.lit("a"), F.col("doc").cast("string"))).otherwise(F.array().cast("array<string>"))
    return t("old_notes").select("doc", notes.with_warning_callout(F.col("body"), warnings).alias("body"))


TEMPLATE = """# {{title}} {{tags_inline}}
{{#if source}}from {{source}}{{/if}}
{{#each pages}}## {{page_number}}
{{#each highlights}}{{index}}. {{text}} ({{color}}) {{pdf_link}}{{/each}}
{{#if annotation}}![[{{annotation}}]]{{/if}}{{#if ocr}}
{{ocr}}{{/if}}
{{/each_pages}}



{{highlight_count}} of {{uuid}} on {{date}}"""


@query(
    "render_with_template",
    "section_docs page_highlights drawings page_ocr",
    PAGES + f""",
    texts AS (SELECT doc, string_agg('## ' || page || {NL} || coalesce(array_to_string(list_transform(hs, lambda h, i: i || '. ' || h.t || ' (' || coalesce(h.c, 'yellow') || ') [[' || pdf_name || '#page='
            || page || '|Page ' || page || ']]'), {NL}), '') || {NL} || coalesce('![[' || filename || ']]', '')
            || coalesce({NL} || replace(replace(ocr, '{{{{', '{{ {{'), '}}}}', '}} }}'), '') || {NL}, {NL} ORDER BY page) AS content, sum(coalesce(len(hs), 0)) AS n
        FROM pages JOIN section_docs USING (doc) GROUP BY doc)""",
    f"""SELECT d.doc, regexp_replace('# T' || d.doc || ' a, b' || {NL} || CASE WHEN d.doc % 2 = 0 THEN 'from s' ELSE '' END || {NL} || coalesce(content, '_No highlights or annotations found._')
        || {NL} || {NL} || {NL} || {NL} || coalesce(n, 0) || ' of u' || d.doc || ' on 1970-01-02', '[' || {NL} || ']{{3,}}', {NL} || {NL}, 'g') AS body FROM section_docs d LEFT JOIN texts USING (doc)""",
)
def render_with_template(t):
    docs = t("section_docs").select(
        "doc",
        "pdf_name",
        F.concat(F.lit("u"), F.col("doc").cast("string")).alias("uuid"),
        F.concat(F.lit("T"), F.col("doc").cast("string")).alias("name"),
        F.lit("pdf").alias("doc_type"),
        F.lit(86400000).alias("last_modified"),
        F.when(F.col("doc") % 2 == 0, F.lit("s")).alias("source_label"),
        F.array(F.lit("a"), F.lit("b")).alias("tags"),
    )
    rendered = template.render_with_template(docs, t("page_highlights"), t("drawings"), t("page_ocr"), TEMPLATE)
    return rendered.select("doc", "body")


@query("write_notes", "old_notes", "", "SELECT path, body FROM old_notes")
def write_notes(t):
    folder = f"{shared_folder(t.spark)}/notes"
    store.write_notes(t("old_notes").select("path", "body"), folder, "run-1")
    return store.published_notes(t.spark, folder)


# --- review ----------------------------------------------------------------------------------------------------------

STATE = """
    acts AS (SELECT *, row_number() OVER (PARTITION BY highlight_id ORDER BY ts DESC, event_id DESC) AS r FROM review_events WHERE action <> 'look'),
    last_act AS (SELECT highlight_id, CASE action WHEN 'dismiss' THEN 'dismissed' WHEN 'undo' THEN 'pending' ELSE CASE WHEN edited_text IS NOT NULL THEN 'edited' ELSE 'accepted' END END AS status
        FROM acts WHERE r = 1),
    said AS (SELECT highlight_id, edited_text FROM (SELECT highlight_id, CASE WHEN action = 'accept' THEN edited_text END AS edited_text,
        row_number() OVER (PARTITION BY highlight_id ORDER BY r) AS k FROM acts WHERE action <> 'dismiss') WHERE k = 1),
    state AS (SELECT l.highlight_id, l.status, s.edited_text FROM last_act l LEFT JOIN said s USING (highlight_id))"""
ORDER = ("ts", "event_id")


def review_state(t):
    return review.reduce_review(t("review_events"), ORDER)


@query("reduce_review", "review_events", STATE, "SELECT highlight_id, status, edited_text FROM state")
def reduce_review(t):
    return review_state(t)


JUDGED = STATE + ", judged AS (SELECT h.*, coalesce(s.status, 'pending') AS status, s.edited_text FROM found_highlights h LEFT JOIN state s ON s.highlight_id = h.id)"


@query("pending_review", "found_highlights review_events", JUDGED, "SELECT id, uuid, status FROM judged WHERE status NOT IN ('accepted', 'edited')")
def pending_review(t):
    return review.pending_review(t("found_highlights"), review_state(t)).select("id", "uuid", "status")


@query(
    "review_summary",
    "found_highlights review_events",
    JUDGED,
    """SELECT count(DISTINCT uuid) FILTER (status = 'pending') AS documents_with_pending, count(*) FILTER (status = 'pending') AS total_pending,
        count(*) FILTER (status IN ('accepted', 'edited')) AS total_accepted, count(*) FILTER (status = 'dismissed') AS total_dismissed FROM judged""",
)
def review_summary(t):
    return review.review_summary(review.with_review_state(t("found_highlights"), review_state(t)))


@query(
    "accepted_export",
    "found_highlights review_events",
    JUDGED,
    f"""SELECT uuid, string_agg('> ' || replace(coalesce(edited_text, text), {NL}, {NL} || '> ') || {NL} || '> -- [[' || pdf_name || '#page=' || page || '|Page ' || page || ']]'
        || CASE WHEN color <> 'yellow' THEN {NL} || '<!-- highlight-color: ' || color || ' -->' ELSE '' END || {NL}, {NL} ORDER BY seq) AS body
    FROM judged WHERE status IN ('accepted', 'edited') GROUP BY uuid""",
)
def accepted_export(t):
    return review.accepted_export(review.with_review_state(t("found_highlights"), review_state(t)))
