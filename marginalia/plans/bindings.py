"""Canonical input tables derived from the given tables.

Each text is valid in Spark SQL and in ANSI engines alike, so that a query and its oracle read the same rows; only
exploding a text into words is written twice.  ``EACH(name: a, b)`` repeats a row for every listed value.  No text uses
a backslash, which the engines read differently.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.session import written
from marginalia.streaming.run import run_batches

RAW = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def uuid_of(number: str) -> str:
    return f"concat('00000000-0000-4000-8000-', lpad(CAST({number} AS STRING), 12, '0'))"


def div(a: str, b: int) -> str:
    return f"CAST(FLOOR(({a}) / {b}) AS BIGINT)"


U = uuid_of("doc_id")
# Three sources; each has a tree of its own, in which the children of number k are 3 k, 3 k + 1 and 3 k + 2.
STORE = "concat('s', CAST(doc_id % 3 AS STRING))"
ABOVE = f"3 * {div('doc_id', 9)} + doc_id % 3"
NL = "chr(10)"
LINE_ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate"
START = "CASE WHEN doc_id % 2 = 0 THEN '<!-- marginalia:start -->' ELSE '<!-- marginalia-v0:start -->' END"
END = "CASE WHEN doc_id % 2 = 0 THEN '<!-- marginalia:end -->' ELSE '<!-- marginalia-v0:end -->' END"
Q1 = "text"
Q2 = "concat('Re: ', text)"
TYPED = "'<!-- notes -->'"
TYPED_END = "'<!-- /notes -->'"


def typed(content: str) -> str:
    return f"{TYPED}, {NL}, {content}, {NL}, {TYPED_END}, {NL}"


def quote(text: str, page: str) -> str:
    return f"'> ', replace({text}, {NL}, concat({NL}, '> ')), {NL}, '> -- [[', {U}, '.pdf#page=', {page}, '|Page ', {page}, ']]', {NL}"


def header(count: str) -> str:
    return (
        f"'---', {NL}, 'title: \"', {U}, '\"', {NL}, 'highlight_count: ', {count}, {NL}, 'remarkable_uuid: ', {U}, {NL}, '---', {NL}, {NL}"
    )


FILE_NUMBER = "CASE ext WHEN '.metadata' THEN 0 WHEN '.content' THEN 1 WHEN '.pdf' THEN 2 ELSE 3 END"
FILE_NAME = f"""concat({U}, CASE doc_id % 7 WHEN 0 THEN '.metadata' WHEN 1 THEN '.content' WHEN 2 THEN '.pdf'
    WHEN 3 THEN '.epub' WHEN 4 THEN '.pagedata' WHEN 5 THEN '.sync-conflict-1.metadata' ELSE '' END)"""

# name -> text, or (Spark text, oracle text)
INPUTS: dict[str, str | tuple[str, str]] = {
    # --- catalogue
    "entries": f"""
        SELECT {STORE} AS source_id, {U} AS uuid, concat(lang, ' ', CAST(n_chars AS STRING)) AS name,
            CASE WHEN doc_id = 190 THEN {uuid_of('193')} WHEN doc_id = 193 THEN {uuid_of('190')}
                WHEN doc_id > 40 AND doc_id % 31 = 0 THEN 'trash' WHEN doc_id < 3 THEN ''
                ELSE {uuid_of(ABOVE)} END AS parent,
            CASE WHEN 9 * {div('doc_id', 3)} + 3 + doc_id % 3 <= (SELECT max(doc_id) FROM documents) THEN 'CollectionType'
                ELSE 'DocumentType' END AS entry_type,
            n_chars * 1000 AS last_modified, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE n_chars * 900 END AS last_opened,
            n_chars * 800 AS created, doc_id > 40 AND doc_id % 23 = 0 AS deleted
        FROM documents""",
    "contents": f"""
        SELECT {STORE} AS source_id, {U} AS uuid,
            CASE doc_id % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'epub' WHEN 2 THEN '' WHEN 3 THEN 'notebook' WHEN 4 THEN 'PDF' ELSE 'djvu' END
                AS file_type,
            CAST(1 + n_chars % 9 AS INT) AS page_count, doc_id % 17 = 0 AND doc_id % 3 <> 2 AS is_corrupt
        FROM documents WHERE lang <> 'de' OR doc_id % 3 = 2""",
    "all_contents": f"""
        SELECT {U} AS uuid, CASE doc_id % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'epub' WHEN 2 THEN '' WHEN 3 THEN 'notebook' WHEN 4 THEN 'PDF' ELSE 'djvu' END
            AS file_type FROM documents""",
    "library": f"""
        SELECT concat('s', CAST(doc_id % 3 AS STRING)) AS source_id, {U} AS uuid, concat(upper(lang), ' ', CAST(n_chars AS STRING), ' ', source) AS name,
            CASE doc_id % 4 WHEN 0 THEN 'epub' WHEN 1 THEN 'notebook' ELSE 'pdf' END AS doc_type,
            n_chars * 1000 AS last_modified, n_chars % 5 AS highlight_count, concat(source, '/', lang) AS folder_path,
            CASE WHEN doc_id % 11 = 0 THEN 'pending' WHEN doc_id % 11 = 1 THEN 'error' WHEN doc_id % 11 = 2 THEN 'archived'
                ELSE 'synced' END AS sync_status
        FROM documents""",
    "shelf": f"""
        SELECT {U} AS uuid, concat(CASE doc_id % 5 WHEN 0 THEN lang WHEN 1 THEN upper(lang) WHEN 2 THEN concat('é', lang) WHEN 3 THEN concat('E', lang)
            ELSE concat('É', lang) END, ' ', CAST(n_chars % 50 AS STRING)) AS name FROM documents""",
    "cursors": "SELECT 's0' AS source_id, CAST(2000000 AS BIGINT) AS cursor_ms UNION ALL SELECT 's1', 1000000",
    "metadata_json": f"""
        SELECT concat('s', CAST(doc_id % 3 AS STRING)) AS source_id, {U} AS uuid,
            concat('{{"visibleName":"', lang, CAST(doc_id AS STRING), '","parent":"', source, '"',
                CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 7 = 0 THEN concat(',"lastModified":', CAST(n_chars AS STRING))
                    WHEN doc_id % 29 = 0 THEN ',"lastModified":"soon"'
                    ELSE concat(',"lastModified":"', CAST(n_chars AS STRING), '000"') END,
                CASE WHEN doc_id % 4 = 0 THEN ',"type":"CollectionType"' WHEN doc_id % 4 = 1 THEN ',"type":7' ELSE '' END,
                CASE WHEN doc_id % 6 = 0 THEN ',"deleted":true' WHEN doc_id % 6 = 1 THEN ',"deleted":"yes"' ELSE '' END,
                ',"version":', CAST(doc_id % 3 AS STRING), CASE WHEN doc_id % 17 = 0 THEN '' ELSE '}}' END) AS value
        FROM documents""",
    "content_json": f"""
        SELECT 's0' AS source_id, {U} AS uuid,
            CASE WHEN doc_id % 3 = 0 THEN concat('{{"fileType":"pdf","pages":["a', CAST(doc_id AS STRING), '","b"],"redirectionPageMap":[1,0]',
                    CASE WHEN doc_id % 2 = 0 THEN ',"pageCount":5' ELSE '' END, CASE WHEN doc_id % 17 = 0 THEN '' ELSE '}}' END)
                WHEN doc_id % 3 = 1 THEN concat('{{"cPages":{{"pages":[{{"id":"p1","template":{{"value":"P ', lang, '"}}}},',
                    '{{"id":"p2","deleted":true}},{{"uuid":"p3","redir":{{"value":', CAST(n_chars % 9 AS STRING), '}}}},{{"id":"p4","template":"Blank"}}]}},',
                    '"tags":["', source, '",{{"name":"', lang, '"}},""],"pageTags":[{{"name":"x","pageId":"p1"}},{{"name":"y","pageId":"p3"}}]}}')
                ELSE '{{}}' END AS value
        FROM documents""",
    "payloads": f"""
        SELECT doc_id AS payload_id, concat('{{"success":true,"documents":[{{"uuid":"', {U}, '","visible_name":',
            CASE WHEN doc_id % 5 = 0 THEN '7' ELSE '"v"' END, ',"folder_path":"","doc_type":"pdf","last_modified":', CAST(n_chars AS STRING),
            ',"page_count":1,"has_pdf":true,"highlights":[{{"text":"t","page_number":',
            CASE WHEN doc_id % 7 = 0 THEN '"1"' ELSE '1' END, ',"color":null,"bounds":null,"created_at":null}}],"error":null}}]',
            CASE WHEN doc_id % 17 = 0 THEN '' ELSE '}}' END) AS value
        FROM documents""",
    # --- stores
    "listing": f"""
        SELECT {FILE_NAME} AS name, doc_id % 7 = 6 AS is_dir FROM documents
        UNION ALL SELECT CASE doc_id % 4 WHEN 0 THEN '.stignore' WHEN 1 THEN '.stfolder' WHEN 2 THEN concat({U}, '.cache') ELSE '.local' END, doc_id % 4 IN (1, 2)
        FROM documents""",
    "inventory": f"""
        SELECT concat(CASE WHEN doc_id % 10 = 9 THEN '/elsewhere/' ELSE '/store/' END, {U}, tail) AS path, n_chars AS size, 1700000000 + n_chars AS mtime_s
        FROM documents EACH(tail: '.metadata', '.content', '.pdf', '/p1.rm', '/p2.rm', '.textconversion/a.txt')""",
    "remote": f"""
        SELECT concat('s', CAST(doc_id % 2 AS STRING)) AS source_id, {U} AS uuid, concat({U}, ext) AS path, concat({U}, ext) AS name,
            ext, CASE WHEN ext = '' THEN 0 ELSE n_chars + {FILE_NUMBER} END AS size, 1700000000 + n_chars AS mtime_s, ext = '' AS is_dir
        FROM documents EACH(ext: '.metadata', '.content', '.pdf', '')""",
    "local": f"""
        SELECT concat('s', CAST(doc_id % 2 AS STRING)) AS source_id, {U} AS uuid, concat({U}, ext) AS path, concat({U}, ext) AS name,
            ext, CASE WHEN ext = '' THEN 0 WHEN doc_id % 11 = 0 THEN n_chars + {FILE_NUMBER} + 1 ELSE n_chars + {FILE_NUMBER} END AS size,
            1700000000 + n_chars - CASE WHEN doc_id % 13 = 0 THEN 5 ELSE 0 END AS mtime_s, ext = '' AS is_dir
        FROM documents EACH(ext: '.metadata', '.content', '.pdf', '')
        WHERE NOT (lang = 'es' AND ext IN ('.metadata', '')) AND NOT (lang = 'de' AND ext = '.content') AND NOT (lang = 'fr' AND ext = '.pdf')""",
    "store_files": f"""
        SELECT 's0' AS source_id, {U} AS uuid, concat({U}, tail) AS path, n_chars % 40 AS size, FALSE AS is_dir, doc_id
        FROM documents EACH(tail: '.metadata', '.content', '.pdf', '/p1.rm', '.cache/p1.png', '.pagedata')""",
    "kept_files": """
        SELECT source_id, uuid, path, CASE WHEN doc_id % 11 = 0 AND path LIKE '%.rm' THEN size + 1 ELSE size END AS size, is_dir
        FROM store_files WHERE NOT (doc_id % 5 = 0 AND path LIKE '%.pdf') AND NOT (doc_id % 7 = 0 AND path LIKE '%.content')
            AND path NOT LIKE '%cache%' AND path NOT LIKE '%.pagedata'""",
    "transfers": f"""
        SELECT 's0' AS source_id, {U} AS uuid, concat({U}, ext) AS path, ext, ext = '.rm' AS is_page, ext = '.rm' AND doc_id % 4 = 0 AS failed
        FROM documents EACH(ext: '.metadata', '.content', '.pdf', '.rm')""",
    "sizes": f"SELECT {STORE} AS source_id, {U} AS uuid, n_chars AS size FROM documents",
    "verified": f"SELECT {STORE} AS source_id, {U} AS uuid, doc_id % 6 <> 0 AS verified FROM documents",
    "stores": f"SELECT {STORE} AS source_id, CAST(sum(n_chars) AS BIGINT) AS used, CAST(sum(n_chars) AS DOUBLE) / 0.9 AS capacity FROM documents GROUP BY {STORE}",
    "registry": f"""
        SELECT {U} AS uuid, concat(lang, CASE WHEN doc_id % 2 = 0 THEN '' ELSE CAST(doc_id AS STRING) END) AS base_name,
            n_chars % 4 AS highlight_count FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)""",
    "note_headers": "SELECT uuid, concat('notes/', base_name, '.md') AS path, base_name FROM registry",
    "named_docs": f"""
        SELECT {U} AS uuid, CASE WHEN doc_id % 4 = 0 THEN concat(text, '.pdf') WHEN doc_id % 4 = 1 THEN concat(lang, ': ?')
            ELSE concat(' ', lang, ' <', CAST(doc_id AS STRING), '>.EPUB') END AS visible_name FROM documents""",
    "owned_docs": f"SELECT {U} AS uuid, concat(lang, CAST(doc_id % 20 AS STRING)) AS base_name FROM documents",
    "owned_files": f"""
        SELECT concat('f/', name) AS path, name FROM (SELECT concat(CASE kind WHEN 1 THEN '.render-cache-' ELSE '' END,
                CASE WHEN kind < 2 THEN {U} WHEN kind = 2 THEN concat(lang, CAST(doc_id % 20 AS STRING)) ELSE concat(lang, CAST(doc_id AS STRING)) END,
                CASE kind WHEN 0 THEN '.pdf' WHEN 1 THEN '.json' WHEN 2 THEN '_p3_a4af.png' WHEN 3 THEN '.md' ELSE '_p1.png.bak' END) AS name
            FROM documents EACH(kind: 0, 1, 2, 3, 4)) f""",
    # --- pages, words, strokes
    "fragments": f"""
        SELECT doc, page, rn AS seq, CASE WHEN rn % 6 = 0 THEN substring(p_name, 4, 3) ELSE p_name END AS text, color,
            CASE WHEN rn % 29 = 28 THEN NULL ELSE CAST(72 + 90 * (rn % 4) + l_suppkey % 3 AS DOUBLE) END AS x,
            CASE WHEN rn % 29 = 28 THEN NULL ELSE CAST(24 * FLOOR((rn % 24) / 4) + 3 * (l_partkey % 4) AS DOUBLE) END AS y,
            CASE WHEN rn % 29 = 28 THEN NULL ELSE CAST(60 + l_partkey % 40 AS DOUBLE) END AS w,
            CASE WHEN rn % 29 = 28 THEN NULL ELSE CAST(14 AS DOUBLE) END AS h
        FROM (SELECT d.doc, d.rn, CAST(1 + FLOOR(d.rn / 24) AS INT) AS page, d.l_partkey, d.l_suppkey, p_name,
                CASE WHEN d.l_suppkey % 5 = 0 THEN 'pink' ELSE 'yellow' END AS color
            FROM (SELECT {div('l_orderkey', 8)} AS doc, l_partkey, l_suppkey,
                    CAST(row_number() OVER (PARTITION BY {div('l_orderkey', 8)} ORDER BY {LINE_ORDER}) - 1 AS BIGINT) AS rn FROM lineitem) d
            JOIN part ON d.l_partkey = p_partkey) f""",
    "fragment_gutters": "SELECT doc, page, CAST(250.0 AS DOUBLE) AS gutter_x FROM fragments GROUP BY doc, page HAVING count(*) < 12",
    "doc_words": (
        "SELECT doc_id, CAST(pos AS BIGINT) AS pos, word FROM documents LATERAL VIEW posexplode(split(text, ' ')) w AS pos, word",
        "SELECT doc_id, unnest(range(len(w))) AS pos, unnest(w) AS word FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)",
    ),
    "words": f"""
        SELECT doc_id AS doc, CAST(1 + FLOOR(pos / 480) AS INT) AS page, pos AS word_id, word, CAST(50 * (pos % 12) AS DOUBLE) AS x0,
            CAST(14 * FLOOR((pos % 480) / 12) AS DOUBLE) AS y0, CAST(50 * (pos % 12) + 45 AS DOUBLE) AS x1,
            CAST(14 * FLOOR((pos % 480) / 12) + 12 AS DOUBLE) AS y1 FROM doc_words""",
    "lines": "SELECT doc, page, CAST(FLOOR(word_id / 12) AS BIGINT) AS hl_id, max(y0) AS y0 FROM words GROUP BY doc, page, CAST(FLOOR(word_id / 12) AS BIGINT)",
    "rects": """
        SELECT doc, page, hl_id, rect_id, CAST(60 - 60 * rect_id AS DOUBLE) AS x, y0 + 2 + 13 * rect_id AS y,
            CAST(300 - 180 * rect_id AS DOUBLE) AS w, CAST(8 AS DOUBLE) AS h
        FROM lines EACH(rect_id: 0, 1)""",
    "page_gutters": "SELECT doc, page, CAST(306.0 AS DOUBLE) AS gutter_x FROM words GROUP BY doc, page HAVING count(*) < 400",
    "blocks": f"""
        SELECT doc_id AS doc, CAST(1 + FLOOR(pos / 480) AS INT) AS page, word AS text, CAST(612.0 AS DOUBLE) AS page_width,
            CAST(CASE (FLOOR(pos / 40) + doc_id) % (2 + doc_id % 3) WHEN 0 THEN 40 WHEN 1 THEN 332 ELSE 100 END AS DOUBLE) AS x0,
            CAST(CASE (FLOOR(pos / 40) + doc_id) % (2 + doc_id % 3) WHEN 0 THEN 280 WHEN 1 THEN 570 ELSE 500 END AS DOUBLE) AS x1
        FROM doc_words""",
    "strokes": f"""
        SELECT {div('o_orderkey', 64)} AS doc, CAST(1 + FLOOR(o_orderkey / 8) % 8 AS INT) AS page, o_orderkey AS stroke_id,
            CAST(o_orderkey % 24 AS INT) AS pen_type,
            CASE o_custkey % 3 WHEN 0 THEN 'yellow' WHEN 1 THEN 'green' ELSE 'pink' END AS color, CAST(1 + o_custkey % 3 * 7 AS DOUBLE) AS width FROM orders""",
    "stroke_points": f"""
        SELECT {div('l_orderkey', 64)} AS doc, CAST(1 + FLOOR(l_orderkey / 8) % 8 AS INT) AS page, l_orderkey AS stroke_id,
            CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE_ORDER}) - 1 AS BIGINT) AS pt,
            CAST(l_partkey % 1500 - 100 AS DOUBLE) AS x, CAST((l_suppkey * 20 + l_orderkey % 7 * 300) % 2200 - 60 AS DOUBLE) AS y,
            l_quantity AS speed, l_quantity - 5 AS width, l_discount AS pressure, CAST(l_partkey % 60 AS DOUBLE) AS tilt FROM lineitem""",
    "curve_points": (
        """SELECT CAST(FLOOR(vec_id / 10) AS BIGINT) AS doc, CAST(vec_id % 10 AS INT) AS page, vec_id AS stroke_id, CAST(pos AS BIGINT) AS pt,
            CAST(v AS DOUBLE) * 100 AS x, CAST(v AS DOUBLE) * 50 AS y, 1.0D AS speed, CAST(FLOOR(abs(CAST(v AS DOUBLE)) * 700) AS DOUBLE) AS width, 0.5D AS pressure,
            CAST(FLOOR(abs(CAST(v AS DOUBLE)) * 200) AS DOUBLE) AS tilt FROM embeddings LATERAL VIEW posexplode(embedding) e AS pos, v""",
        """SELECT CAST(FLOOR(vec_id / 10) AS BIGINT) AS doc, CAST(vec_id % 10 AS INT) AS page, vec_id AS stroke_id, CAST(pos AS BIGINT) AS pt,
            CAST(v AS DOUBLE) * 100 AS x, CAST(v AS DOUBLE) * 50 AS y, 1.0 AS speed, CAST(FLOOR(abs(CAST(v AS DOUBLE)) * 700) AS DOUBLE) AS width, 0.5 AS pressure,
            CAST(FLOOR(abs(CAST(v AS DOUBLE)) * 200) AS DOUBLE) AS tilt
        FROM (SELECT vec_id, unnest(range(len(embedding))) AS pos, unnest(embedding) AS v FROM embeddings)""",
    ),
    "curves": """
        SELECT CAST(FLOOR(vec_id / 10) AS BIGINT) AS doc, CAST(vec_id % 10 AS INT) AS page, vec_id AS stroke_id,
            CAST(vec_id % 24 AS INT) AS pen_type, 'black' AS color, CAST(1 + label % 3 AS DOUBLE) AS width FROM embeddings""",
    "doc_pages": f"""
        SELECT 's0' AS source_id, {uuid_of(div('o_custkey', 1))} AS uuid, o_orderkey AS page_key, concat('p', CAST(o_orderkey AS STRING)) AS page_id,
            CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS page_idx,
            CASE WHEN o_custkey % 2 = 0 AND o_orderkey % 4 <> 0 THEN CAST(o_orderkey % 5 AS INT) END AS pdf_idx FROM orders""",
    "page_files": f"""
        SELECT 's0' AS source_id, {uuid_of('o_custkey')} AS uuid, concat('p', CAST(o_orderkey AS STRING), '.rm') AS name, '.rm' AS ext,
            CAST(FLOOR(o_totalprice) AS BIGINT) % 300 AS size FROM orders WHERE o_orderstatus <> 'P'""",
    "page_strokes": f"""
        SELECT 's0' AS source_id, p.uuid, p.page_idx FROM doc_pages p JOIN lineitem ON l_orderkey = p.page_key""",
    "page_tag_rows": f"""
        SELECT 's0' AS source_id, {uuid_of('o_custkey')} AS uuid, concat('p', CAST(o_orderkey AS STRING)) AS page_id, tag_idx,
            concat(lower(o_orderstatus), CAST(tag_idx AS STRING)) AS tag
        FROM orders EACH(tag_idx: 0, 1) WHERE tag_idx = 0 OR o_orderstatus = 'F'""",
    "turn_words": (
        "SELECT conv_id, turn, CAST(pos AS BIGINT) AS pos, word FROM conversations LATERAL VIEW posexplode(split(text, ' ')) w AS pos, word",
        "SELECT conv_id, turn, unnest(range(len(w))) AS pos, unnest(w) AS word FROM (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations)",
    ),
    "ocr_words": f"""
        SELECT conv_id AS doc, CAST(1 + turn % 2 AS INT) AS page, CAST(turn AS INT) AS block, CAST(0 AS INT) AS par, CAST(FLOOR(pos / 8) AS INT) AS line,
            pos, word, CAST((length(word) * 7 + conv_id * 3) % 40 - 5 AS DOUBLE) AS conf FROM turn_words""",
    # --- notes
    "old_notes": f"""
        SELECT doc_id AS doc, concat('notes/', lang, CAST(doc_id AS STRING), '.md') AS path, CASE WHEN doc_id % 13 = 0
            THEN concat({header("'3'")}, 'plain text ', {Q1}, {NL}, '   ', {NL})
            ELSE concat({header("'2'")}, {START}, {NL}, '### Page 1', {NL}, {NL}, {quote(Q1, "'1'")}, {typed(f"concat('on ', {Q2})")}, {NL},
                {quote(Q2, "'3'")}, {TYPED}, {TYPED_END}, {NL}, {NL}, '![[', lang, '_p1_a4af.png|900]]', {NL}, {typed("'about the image'")}, {NL},
                '### Page 7', {NL}, {typed("lang")}, {END}, {NL}, 'tail of ', lang, {NL}) END AS body
        FROM documents""",
    "new_sections": f"""
        SELECT doc_id AS doc, concat('<!-- marginalia:start -->', {NL}, '### Page 1', {NL}, {NL},
                CASE WHEN doc_id % 3 = 0 THEN concat({quote(Q2, "'9'")}) ELSE concat({quote(Q1, "'1'")}, {TYPED}, {NL}, {TYPED_END}, {NL}) END, {NL},
                '![[', lang, '_p1_b2c1.png|500]]', {NL}, {TYPED}, {TYPED_END}, {NL}, '<!-- marginalia:end -->') AS section,
            n_chars % 50 AS highlight_count FROM documents""",
    "fresh_notes": f"""
        SELECT s.doc, concat('---', {NL}, 'title: "new"', {NL}, 'highlight_count: ', CAST(s.highlight_count AS STRING), {NL}, '---', {NL}, {NL}, s.section, {NL})
            AS body, s.section, s.highlight_count FROM new_sections s""",
    "page_highlights": """
        SELECT doc, page, seq, text, CASE WHEN seq % 7 = 0 THEN NULL ELSE color END AS color FROM fragments""",
    "drawings": "SELECT DISTINCT doc, CAST(page + doc % 2 AS INT) AS page, concat('d', CAST(doc AS STRING), '_p', CAST(page + doc % 2 AS STRING), '.png') AS filename FROM fragments WHERE color = 'pink'",
    "page_ocr": f"SELECT DISTINCT doc, page, concat('written', {NL}, 'by {{{{hand}}}} ', CAST(doc AS STRING)) AS ocr_text FROM fragments WHERE x IS NULL",
    "section_docs": f"""
        SELECT DISTINCT {div('o_orderkey', 8)} AS doc, concat('d', CAST({div('o_orderkey', 8)} AS STRING), '.pdf') AS pdf_name,
            {div('o_orderkey', 8)} % 9 = 0 AS is_notebook FROM orders""",
    "section_tags": "SELECT DISTINCT doc, page, concat('t', CAST(doc % 3 AS STRING)) AS tag FROM fragments WHERE text LIKE 'hot%'",
    "note_docs": f"""
        SELECT doc_id AS doc, {U} AS uuid, concat(replace(text, '"', '~'), CASE WHEN doc_id % 2 = 0 THEN '.pdf' ELSE '"q"' END) AS name,
            CASE WHEN doc_id % 5 = 0 THEN 'notebook' ELSE 'pdf' END AS doc_type, n_chars * 86400000 AS last_modified,
            CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source END AS source_label, lang, source, n_chars FROM documents""",
    "note_inputs": f"""
        SELECT doc_id AS doc, lang AS name, CASE WHEN doc_id % 4 = 0 THEN 'notebook' ELSE 'pdf' END AS doc_type,
            CASE WHEN doc_id % 3 = 0 THEN 0 ELSE n_chars END AS n_highlights, CASE WHEN doc_id % 8 = 3 THEN 1 ELSE 0 END AS n_rendered,
            doc_id % 2 AS n_drawings, CASE WHEN doc_id % 5 = 0 THEN source END AS extract_error, doc_id % 7 = 0 AS render_failed,
            doc_id % 6 < 3 AS has_note FROM documents""",
    # --- review, runs, events
    "review_events": """
        SELECT concat('h', CAST(user_id AS STRING), CAST(event_id % 9 AS STRING)) AS highlight_id, event_id, CAST(ts AS TIMESTAMP) AS ts,
            CASE event_type WHEN 'click' THEN 'accept' WHEN 'purchase' THEN 'accept' WHEN 'view' THEN 'dismiss' WHEN 'error' THEN 'undo' ELSE 'look' END
                AS action,
            CASE WHEN event_type = 'purchase' THEN props END AS edited_text FROM events""",
    "found_highlights": f"""
        SELECT {uuid_of('user_id')} AS uuid, concat('h', CAST(user_id AS STRING), CAST(k AS STRING)) AS id, k AS seq, CAST(1 + k AS INT) AS page,
            concat('text ', CAST(k AS STRING), {NL}, 'of ', CAST(user_id AS STRING)) AS text,
            CASE WHEN k % 3 = 0 THEN 'yellow' WHEN k % 3 = 1 THEN 'pink' END AS color, concat('u', CAST(user_id AS STRING), '.pdf') AS pdf_name
        FROM (SELECT DISTINCT user_id, event_id % 12 AS k FROM events) e""",
    "run_documents": """
        SELECT source AS source_id, doc_id AS doc, n_chars % 6 AS n_highlights, CASE WHEN doc_id % 4 <> 0 THEN lang END AS output_file,
            CASE WHEN doc_id % 9 = 0 THEN 'failed' END AS error FROM documents""",
    "cursor_docs": """
        SELECT source AS source_id, n_chars * 1000 AS last_modified,
            CASE WHEN source IN ('src1', 'src3') AND doc_id % 50 = 1 THEN 'pending_missing' ELSE 'ready' END AS readiness FROM documents""",
    "upkeep_arrivals": f"""
        SELECT doc_id * 7 % 3 AS arrival, source AS source_id, {U} AS uuid, n_chars * 1000 AS last_modified,
            CASE WHEN source IN ('src1', 'src3', 'src6') AND doc_id % 50 < 3 THEN 'pending_missing' ELSE 'ready' END AS readiness FROM documents
        UNION ALL SELECT 3 + doc_id % 2, source, {U}, n_chars * 1000, 'ready'
        FROM documents WHERE source IN ('src1', 'src6') AND doc_id % 50 < 3""",
    "source_runs": """
        SELECT source AS source_id, max(CASE WHEN source = 'src4' THEN 0 ELSE 1 END) = 1 AS full_scan,
            max(CASE WHEN source = 'src5' THEN 2 ELSE 0 END) AS errors, TRUE AS clean_transfer FROM documents GROUP BY source""",
    "source_prev": """
        SELECT source AS source_id, CAST(20000000 AS BIGINT) + max(doc_id) * 1000 AS cursor_ms,
            CASE WHEN source = 'src2' THEN 'old' ELSE 'now' END AS path_hash FROM documents WHERE source <> 'src0' GROUP BY source""",
    "source_paths": "SELECT DISTINCT source AS source_id, 'now' AS current_hash FROM documents",
    "cache_inputs": """
        SELECT doc_id AS doc, concat('p', CAST(doc_id AS STRING)) AS page_id, concat('f', CAST(n_chars AS STRING)) AS filename, n_chars AS rm_mtime,
            CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang END AS template, doc_id % 10 <> 0 AS output_exists FROM documents""",
    "cache_rows": """
        SELECT doc_id AS doc, concat('p', CAST(doc_id AS STRING)) AS page_id, concat('f', CAST(n_chars AS STRING)) AS filename,
            n_chars + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS rm_mtime, CASE WHEN doc_id % 6 = 0 THEN NULL ELSE lang END AS template,
            CASE WHEN doc_id % 2 = 0 THEN source END AS ocr_text, CASE WHEN doc_id % 11 = 0 THEN 'old' ELSE 'now' END AS settings
        FROM documents WHERE lang <> 'de'""",
    "changes": f"""
        SELECT CAST(ts AS TIMESTAMP) AS ts, concat('s', CAST(user_id % 3 AS STRING)) AS source_id,
            concat({uuid_of('user_id')}, CASE event_type WHEN 'click' THEN '.metadata' WHEN 'view' THEN '.content' WHEN 'error' THEN '.tmp'
                WHEN 'signup' THEN '.sync-conflict.metadata' ELSE '/page.rm' END) AS path FROM events""",
    "ignored": f"""
        SELECT {uuid_of('user_id')} AS uuid FROM events GROUP BY user_id HAVING sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) * 4 > count(*)""",
    "outcomes": "SELECT user_id AS key, CAST(ts AS TIMESTAMP) AS ts, event_id AS seq, event_type IN ('error', 'view', 'click') AS failed FROM events",
    "log_text": f"""
        SELECT doc_id AS id, concat(text, CASE WHEN doc_id % 50 = 0 THEN concat(' curl -H ''x-api-key: tok', CAST(doc_id AS STRING), ''' SSHPASS=hunter2 rsync; sshpass -p hunter',
            CAST(doc_id AS STRING), ' x', {NL}, '--Password=abc d --password  efg') ELSE '' END) AS text FROM documents""",
    "devices": """
        SELECT s_suppkey AS device_id, CASE WHEN s_suppkey % 14 = 0 THEN ' ' WHEN s_suppkey % 7 = 0 THEN NULL WHEN s_nationkey % 3 = 0 THEN 'model1'
                WHEN s_nationkey % 3 = 1 THEN 'model2' ELSE 'other' END AS model,
            CASE WHEN s_suppkey % 13 = 0 THEN 'beta' ELSE concat(CAST(1 + s_suppkey % 4 AS STRING), '.', CAST(s_nationkey + 4 AS STRING), '.0.', CAST(s_suppkey AS STRING)) END AS fw,
            CAST(400 + s_suppkey % 3 * 400 AS INT) AS mem_total_mb, CAST(s_suppkey * 7 % 400 AS INT) AS mem_avail_mb, CAST(s_suppkey % 120 AS INT) AS home_avail_mb,
            CAST(80 + s_suppkey % 20 AS INT) AS root_used, s_suppkey % 10 <> 0 AS has_home, s_suppkey % 17 <> 0 AS store_exists FROM supplier""",
    "budgets": """
        SELECT 'model1' AS model, 64 AS sync_memory_mb, 100 AS min_free_memory_mb, 50 AS min_free_storage_mb
        UNION ALL SELECT 'model2', 128, 200, 50 UNION ALL SELECT 'unknown', 64, 100, 50""",
}


# Long bodies are built from few files; they are dealt out by document, once, and not kept.
DEALT = ("old_notes", "new_sections")

# What an extractor leaves in a table of columns: numbering the rows of a document takes a shuffle and a sort of them all.
EXTRACTED = ("fragments",)


EACH = re.compile(r"EACH\((\w+): ([^)]*)\)")


def spark_text(name: str) -> str:
    text = INPUTS[name]
    return EACH.sub(r"LATERAL VIEW explode(array(\2)) each_\1 AS \1", text if isinstance(text, str) else text[0])


def oracle_text(name: str) -> str:
    text = INPUTS[name]
    return EACH.sub(r"CROSS JOIN (SELECT unnest([\2]) AS \1) each_\1", text if isinstance(text, str) else text[1])


class Tables:
    """Given and derived tables by name, as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.bound: set[str] = set()

    def __call__(self, name: str) -> DataFrame:
        if name not in self.bound:
            if name in RAW:
                df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            else:
                text = spark_text(name)
                for other in (*RAW, *INPUTS):
                    if other != name and _mentions(text, other):
                        self(other)
                df = self.spark.sql(text)
                df = df.repartition("doc") if name in DEALT else written(df) if name in EXTRACTED else df
            df.createOrReplaceTempView(name)
            self.bound.add(name)
        return self.spark.table(name)


def streamed(tables: Tables, raw: str, name: str) -> DataFrame:
    """The derived table ``name`` as a stream over the files of the given table ``raw``."""
    spark = tables.spark
    schema = spark.read.parquet(f"{tables.folder}/{raw}.parquet").schema
    files = spark.readStream.schema(schema).option("pathGlobFilter", f"{raw}.parquet").parquet(tables.folder)
    files.createOrReplaceTempView(raw)
    tables.bound.discard(raw)
    return spark.sql(spark_text(name))


def run_arrivals(df: DataFrame, part: str, folder: str, handle, operator=lambda rows: rows, mode: str = "append") -> None:
    """``df`` arrives in the order of its column ``part``; the stream is started anew for each part and goes on where it
    was.  ``operator`` makes the stream of results that ``handle`` gets."""
    for number in [r[0] for r in df.select(part).distinct().orderBy(part).collect()]:
        df.filter(F.col(part) == number).write.mode("append").parquet(f"{folder}/arrivals")
        stream = df.sparkSession.readStream.schema(df.schema).parquet(f"{folder}/arrivals")
        run_batches(operator(stream), mode, folder, handle)


def run_files(df: DataFrame, part: str, folder: str, handle, operator=lambda rows: rows, mode: str = "append") -> None:
    """``df`` arrives as one file per value of its column ``part``, in that order; one run of the stream takes a file at a time."""
    for number in [r[0] for r in df.select(part).distinct().orderBy(part).collect()]:
        df.filter(F.col(part) == number).coalesce(1).write.mode("append").parquet(f"{folder}/arrivals")
    stream = df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/arrivals")
    run_batches(operator(stream), mode, folder, handle)


def _mentions(text: str, name: str) -> bool:
    words = text.replace(",", " ").replace("(", " ").replace(")", " ").split()
    return any(a in ("FROM", "JOIN") and b == name for a, b in zip(words, words[1:]))


def oracle_ctes(names: list[str]) -> str:
    """The derived tables an oracle reads, as common table expressions in order of use."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for other in INPUTS:
            if other != name and _mentions(oracle_text(name), other):
                add(other)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)

    return ",\n".join(f"{name} AS ({oracle_text(name)})" for name in ordered)
