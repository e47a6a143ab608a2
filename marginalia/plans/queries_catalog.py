"""Queries over the catalogue, the folder tree and the two stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.functions import ids, text
from marginalia.operators import catalog, notes, sync, tree
from marginalia.plans.registry import BL, query
from marginalia.sources import json as sidecars
from marginalia.sources import store

TRASH = """
trash(uuid, parent) AS (SELECT uuid, parent FROM entries WHERE parent = 'trash'
    UNION SELECT e.uuid, e.parent FROM entries e JOIN trash t ON e.parent = t.uuid),
live AS (SELECT * FROM entries WHERE NOT deleted AND uuid NOT IN (SELECT uuid FROM trash))"""

# Folders from the roots down; a root is a folder whose parent is no folder.
FOLDERS = """
folders AS (SELECT uuid, parent, name FROM {source} WHERE entry_type = 'CollectionType'),
tree(uuid, names, ids, keys) AS (
    SELECT uuid, [name], [uuid], [('1', name, uuid)] FROM folders WHERE parent NOT IN (SELECT uuid FROM folders)
    UNION ALL SELECT f.uuid, list_append(t.names, f.name), list_append(t.ids, f.uuid), list_append(t.keys, ('1', f.name, f.uuid))
    FROM folders f JOIN tree t ON f.parent = t.uuid)"""

PATHS = """
paths AS (SELECT l.*, coalesce(array_to_string(t.names, '/'), '') AS folder_path
    FROM live l LEFT JOIN tree t ON l.parent = t.uuid)"""


@query("trashed_ids", "entries", TRASH, "SELECT source_id, uuid FROM trash JOIN entries USING (uuid)")
def trashed_ids(t):
    return tree.trashed_ids(t("entries"))


@query("live_entries", "entries", TRASH, "SELECT source_id, uuid, parent, name FROM live")
def live_entries(t):
    return tree.live_entries(t("entries")).select("source_id", "uuid", "parent", "name")


@query("resolve_folder_paths", "entries", TRASH + "," + FOLDERS.format(source="live") + "," + PATHS, "SELECT uuid, name, folder_path FROM paths")
def resolve_folder_paths(t):
    return tree.resolve_folder_paths(t("entries"), live=True).select("uuid", "name", "folder_path")


@query(
    "folder_rollup",
    "entries",
    TRASH + "," + FOLDERS.format(source="live") + """,
    up AS (SELECT uuid, unnest(ids) AS above FROM tree),
    direct AS (SELECT parent AS uuid, count(*) FILTER (entry_type <> 'CollectionType') AS d, count(*) FILTER (entry_type = 'CollectionType') AS f
        FROM live GROUP BY parent),
    total AS (SELECT above AS uuid, sum(d) AS d, sum(f) AS f FROM up JOIN direct USING (uuid) GROUP BY above)""",
    """SELECT f.uuid, coalesce(d.d, 0) AS documents, coalesce(d.f, 0) AS subfolders, CAST(coalesce(t.d, 0) AS BIGINT) AS all_documents,
        CAST(coalesce(t.f, 0) AS BIGINT) AS all_subfolders, coalesce(t.d, 0) = 0 AS is_empty
    FROM folders f LEFT JOIN direct d USING (uuid) LEFT JOIN total t USING (uuid)""",
)
def folder_rollup(t):
    return tree.folder_rollup(tree.live_entries(t("entries"))).drop("source_id", "name")


@query(
    "order_tree",
    "entries",
    TRASH + "," + FOLDERS.format(source="live") + """,
    placed AS (SELECT l.uuid, list_append(coalesce(t.keys, []), (CASE WHEN l.entry_type = 'CollectionType' THEN '1' ELSE '0' END, l.name, l.uuid)) AS k
        FROM live l LEFT JOIN tree t ON l.parent = t.uuid)""",
    "SELECT uuid, CAST(len(k) - 1 AS INTEGER) AS depth, array_to_string(list_transform(k, lambda s: s[1] || s[2] || s[3]), '|') AS sort_key FROM placed",
)
def order_tree(t):
    ordered = tree.order_tree(tree.live_entries(t("entries")))
    steps = F.transform("sort_path", lambda s: F.concat(s["kind"].cast("string"), s["name"], s["uuid"]))
    return ordered.select("uuid", "depth", F.array_join(steps, "|").alias("sort_key"))


READY = """
ready AS (SELECT p.*, c.file_type, CASE WHEN c.uuid IS NULL THEN 'pending_missing' WHEN c.is_corrupt THEN 'pending_corrupt' ELSE 'ready' END AS readiness
    FROM entries p LEFT JOIN contents c USING (source_id, uuid) WHERE entry_type <> 'CollectionType')"""


@query("classify_readiness", "entries contents", READY, "SELECT uuid, readiness FROM ready")
def classify_readiness(t):
    return catalog.classify_readiness(t("entries"), t("contents")).select("uuid", "readiness")


@query("pending_count", "entries contents", READY, "SELECT source_id, count(*) FILTER (readiness <> 'ready') AS pending_count FROM ready GROUP BY source_id")
def pending_count(t):
    return catalog.pending_count(catalog.classify_readiness(t("entries"), t("contents")))


@query(
    "discover_documents",
    "entries contents remote",
    TRASH + "," + FOLDERS.format(source="live") + "," + PATHS,
    """SELECT p.uuid, p.folder_path, CASE WHEN c.file_type IN ('pdf', 'epub') THEN c.file_type ELSE 'notebook' END AS doc_type,
        EXISTS (SELECT 1 FROM remote r WHERE r.ext = '.pdf' AND r.source_id = p.source_id AND r.uuid = p.uuid) AS has_pdf
    FROM paths p JOIN contents c USING (source_id, uuid)
    WHERE entry_type <> 'CollectionType' AND NOT c.is_corrupt AND coalesce(c.file_type, '') IN ('pdf', 'epub', '', 'notebook')""",
)
def discover_documents(t):
    found = catalog.discover_documents(t("entries"), t("contents"), t("remote"))
    return found.select("uuid", "folder_path", "doc_type", "has_pdf")


@query(
    "document_types",
    "all_contents",
    "",
    """SELECT uuid, 'drop' AS mode, CASE WHEN file_type IN ('pdf', 'epub') THEN file_type ELSE 'notebook' END AS doc_type FROM all_contents
        WHERE coalesce(file_type, '') IN ('pdf', 'epub', '', 'notebook')
    UNION ALL SELECT uuid, 'notebook', CASE WHEN lower(file_type) IN ('pdf', 'epub') THEN lower(file_type) ELSE 'notebook' END FROM all_contents""",
)
def document_types(t):
    dropping = catalog.with_document_type(t("all_contents")).select("uuid", F.lit("drop").alias("mode"), "doc_type")
    tolerant = catalog.with_document_type(t("all_contents"), "notebook").select("uuid", F.lit("notebook").alias("mode"), "doc_type")
    return dropping.unionByName(tolerant)


@query("select_documents", "library", "", "SELECT uuid, doc_type FROM library WHERE doc_type IN ('pdf', 'epub')")
def select_documents(t):
    return catalog.select_documents(t("library"), include_notebook=False).select("uuid", "doc_type")


@query(
    "since_cursor",
    "library cursors",
    "",
    """SELECT l.uuid, l.last_modified FROM library l LEFT JOIN cursors c USING (source_id)
    WHERE c.cursor_ms IS NULL OR l.last_modified > c.cursor_ms OR l.doc_type = 'notebook'""",
)
def since_cursor(t):
    return catalog.since(t("library"), t("cursors")).select("uuid", "last_modified")


@query("search_library", "library", "", "SELECT uuid, name FROM library WHERE contains(lower(name), 'fr 1') OR contains(lower(folder_path), 'fr 1')")
def search_library(t):
    return catalog.search_library(t("library"), "Fr 1").select("uuid", "name")


@query("filter_source", "library", "", "SELECT uuid FROM library WHERE source_id = 's1' AND sync_status <> 'archived'")
def filter_source(t):
    return catalog.filter_source(t("library"), "s1").select("uuid")


@query(
    "sort_library",
    "library",
    "",
    "SELECT uuid, name, highlight_count, row_number() OVER (ORDER BY highlight_count DESC, uuid) AS rank FROM library",
)
def sort_library(t):
    return catalog.sort_library(t("library"), "highlight_count", "desc").select("uuid", "name", "highlight_count", "rank")


# Locale order: letters first, then accents, then small before capital letters.
SWAPPED = "translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZÉabcdefghijklmnopqrstuvwxyzé', 'abcdefghijklmnopqrstuvwxyzéABCDEFGHIJKLMNOPQRSTUVWXYZÉ')"
COLLATED = f"lower(strip_accents(name)), CASE WHEN strip_accents(name) <> name THEN 1 ELSE 0 END, {SWAPPED}"


@query("sort_library_by_name", "shelf", "", f"SELECT uuid, name, row_number() OVER (ORDER BY {COLLATED}, uuid) AS rank FROM shelf")
def sort_library_by_name(t):
    return catalog.sort_library(t("shelf"), "name").select("uuid", "name", "rank")


@query(
    "source_presence",
    "library remote",
    "",
    """SELECT l.uuid, count(*) FILTER (r.ext = '.pdf') > 0 AS has_pdf, l.doc_type = 'pdf' AND count(*) FILTER (r.ext = '.pdf') > 0 AS has_source_file
    FROM library l LEFT JOIN remote r USING (source_id, uuid) GROUP BY l.uuid, l.doc_type""",
)
def source_presence(t):
    return catalog.with_source_presence(t("library"), t("remote")).select("uuid", "has_pdf", "has_source_file")


@query(
    "select_requested",
    "library registry contents",
    "",
    """SELECT uuid, 'found' AS result FROM contents WHERE uuid IN (SELECT uuid FROM registry)
    UNION ALL SELECT uuid, 'Document not found: ' || uuid FROM registry WHERE uuid NOT IN (SELECT uuid FROM contents)""",
)
def select_requested(t):
    found, missing = catalog.select_requested(t("contents"), t("registry").select("uuid"))
    errors = catalog.missing_errors(missing).select("uuid", F.col("error").alias("result"))
    return found.select("uuid", F.lit("found").alias("result")).unionByName(errors)


@query(
    "union_sources",
    "library",
    "",
    """SELECT uuid, source_id, sync_status FROM library WHERE source_id = 's0' UNION ALL SELECT uuid, source_id, sync_status FROM library WHERE source_id = 's1'
    UNION ALL SELECT uuid, source_id, 'archived' FROM library WHERE source_id = 's2'""",
)
def union_sources(t):
    one, two, old = (t("library").filter(F.col("source_id") == s) for s in ("s0", "s1", "s2"))
    return catalog.union_sources([one, two], old).select("uuid", "source_id", "sync_status")


ANNOTATED = """
noted AS (SELECT e.uuid, r.base_name, e.last_modified, row_number() OVER (ORDER BY e.last_modified DESC, e.uuid) AS rank
    FROM entries e LEFT JOIN contents c USING (source_id, uuid) JOIN registry r ON r.uuid = e.uuid
    WHERE NOT e.deleted AND e.entry_type <> 'CollectionType' AND lower(coalesce(nullif(c.file_type, ''), 'pdf')) = 'pdf' AND r.highlight_count > 0)"""


def annotated(t, limit=None):
    docs = t("entries").join(t("contents").select("source_id", "uuid", "file_type"), ["source_id", "uuid"], "left")
    return catalog.recent_annotated(docs, t("registry"), limit).select("uuid", "base_name", "last_modified", "rank")


@query("recent_annotated", "entries contents registry", ANNOTATED, "SELECT * FROM noted")
def recent_annotated(t):
    return annotated(t)


@query("recent_annotated_first", "entries contents registry", ANNOTATED, "SELECT * FROM noted WHERE rank <= 25")
def recent_annotated_first(t):
    """The 25 newest, the list's own limit."""
    return annotated(t, 25)


@query(
    "library_summary",
    "library",
    "",
    """SELECT count(*) AS total_documents, count(*) FILTER (sync_status = 'pending') AS pending_documents,
        count(*) FILTER (sync_status = 'error') AS error_documents, CAST(sum(highlight_count) AS BIGINT) AS total_highlights FROM library""",
)
def library_summary(t):
    return catalog.library_summary(t("library"))


@query(
    "merge_tags",
    "note_docs",
    "",
    """SELECT doc, CASE WHEN source = 'src1' THEN lang || ',src1,x' WHEN lang = 'en' THEN 'en,src1,' || source || ',x' ELSE lang || ',src1,' || source || ',x' END AS tags
    FROM note_docs""",
)
def merge_tags(t):
    defaults, own = F.array("lang", F.lit("src1")), F.array("source", F.lit("x"), "lang")
    return t("note_docs").select("doc", F.array_join(catalog.merge_tags(defaults, own), ",").alias("tags"))


# --- sidecars --------------------------------------------------------------------------------------------------------

ENTRY_SQL = """
parsed AS (SELECT source_id, uuid, json_valid(value) AS ok, CASE WHEN json_valid(value) THEN value ELSE '{}' END AS j FROM metadata_json),
typed AS (SELECT source_id, uuid, ok, json_extract_string(j, '$.visibleName') AS name, json_extract_string(j, '$.parent') AS parent,
    CASE WHEN json_type(j, '$.type') = 'VARCHAR' THEN json_extract_string(j, '$.type') ELSE 'DocumentType' END AS entry_type,
    CASE WHEN json_type(j, '$.lastModified') IS NULL THEN 0 ELSE TRY_CAST(json_extract_string(j, '$.lastModified') AS BIGINT) END AS last_modified,
    CASE WHEN json_type(j, '$.deleted') = 'BOOLEAN' THEN CAST(json_extract_string(j, '$.deleted') AS BOOLEAN) ELSE FALSE END AS deleted,
    CAST(json_extract_string(j, '$.version') AS INTEGER) AS version FROM parsed)"""


@query("read_entries", "metadata_json", ENTRY_SQL, "SELECT source_id, uuid, name, parent, entry_type, last_modified, deleted, version FROM typed WHERE ok AND last_modified IS NOT NULL")
def read_entries(t):
    columns = ["source_id", "uuid", "name", "parent", "entry_type", "last_modified", "deleted", "version"]
    return sidecars.read_entries(t("metadata_json")).select(*columns)


@query("count_malformed", "metadata_json", ENTRY_SQL, "SELECT source_id, count(*) AS sidecars, count(*) FILTER (NOT ok OR last_modified IS NULL) AS malformed FROM typed GROUP BY source_id")
def count_malformed(t):
    return sidecars.count_malformed(t("metadata_json"))


CONTENT_SQL = """
c0 AS (SELECT source_id, uuid, json_valid(value) AS ok, CASE WHEN json_valid(value) THEN value ELSE '{}' END AS j FROM content_json),
c1 AS (SELECT *, json_extract(j, '$.cPages.pages[*]') AS newer, json_extract(j, '$.pages[*]') AS older FROM c0),
c2 AS (SELECT *, CASE WHEN len(newer) > 0 THEN list_filter(newer, lambda p: coalesce(json_extract_string(p, '$.deleted'), 'false') <> 'true') ELSE older END AS live FROM c1),
c3 AS (SELECT source_id, uuid, ok, j, live, len(live) AS n, CASE WHEN len(newer) > 0 THEN len(newer) ELSE len(older) END AS listed FROM c2)"""


@query(
    "read_contents",
    "content_json",
    CONTENT_SQL,
    """SELECT uuid, coalesce(json_extract_string(j, '$.fileType'), '') AS file_type,
        CAST(coalesce(CAST(json_extract_string(j, '$.pageCount') AS INTEGER), n) AS INTEGER) AS page_count,
        CAST(coalesce(nullif(CAST(json_extract_string(j, '$.pageCount') AS INTEGER), 0), listed) AS INTEGER) AS listed_pages,
        coalesce(array_to_string(list_filter(list_transform(json_extract(j, '$.tags[*]'),
            lambda x: CASE WHEN json_type(x) = 'OBJECT' THEN json_extract_string(x, '$.name') ELSE json_extract_string(x, '$') END), lambda x: x <> ''), ','), '') AS tags,
        NOT ok AS is_corrupt FROM c3""",
)
def read_contents(t):
    contents = sidecars.read_contents(t("content_json"))
    return contents.withColumn("tags", F.array_join("tags", ",")).select("uuid", "file_type", "page_count", "listed_pages", "tags", "is_corrupt")


@query(
    "number_pages",
    "content_json",
    CONTENT_SQL
    + """,
    c4 AS (SELECT uuid, j, unnest(live) AS p, unnest(range(len(live))) AS i FROM c3)""",
    """SELECT uuid, CAST(i + 1 AS INTEGER) AS page,
        CASE WHEN json_type(p) = 'VARCHAR' THEN json_extract_string(p, '$') ELSE coalesce(json_extract_string(p, '$.id'), json_extract_string(p, '$.uuid')) END AS page_id,
        CASE WHEN json_type(p) = 'VARCHAR' OR json_type(p, '$.template') IS NULL THEN '' WHEN json_type(p, '$.template') = 'OBJECT'
            THEN json_extract_string(p, '$.template.value') ELSE json_extract_string(p, '$.template') END AS template,
        CAST(CASE WHEN json_type(p) = 'VARCHAR' THEN json_extract_string(j, '$.redirectionPageMap[' || i || ']')
            ELSE json_extract_string(p, '$.redir.value') END AS INTEGER) AS pdf_idx FROM c4""",
)
def number_pages(t):
    return sidecars.number_pages(sidecars.read_contents(t("content_json"))).select("uuid", "page", "page_id", "template", "pdf_idx")


@query(
    "quarantine_invalid",
    "payloads",
    """d AS (SELECT payload_id, json_valid(value) AS ok, CASE WHEN json_valid(value) THEN json_extract(value, '$.documents[0]') END AS d FROM payloads)""",
    """SELECT payload_id, CAST(CASE WHEN ok THEN 0 END AS INTEGER) AS doc_idx, json_extract_string(d, '$.uuid') AS uuid,
        CASE WHEN NOT ok THEN 'malformed' WHEN json_type(d, '$.visible_name') <> 'VARCHAR' THEN 'visible_name'
            WHEN json_type(d, '$.highlights[0].page_number') = 'VARCHAR' THEN 'highlight' END AS reason,
        ok AND json_type(d, '$.visible_name') = 'VARCHAR' AND json_type(d, '$.highlights[0].page_number') <> 'VARCHAR' AS accepted FROM d""",
)
def quarantine_invalid(t):
    return sidecars.quarantine_invalid(t("payloads"))


@query(
    "emit_results_json",
    "note_docs page_highlights",
    """h AS (SELECT doc, list({'text': text, 'page_number': page, 'color': color, 'bounds': NULL, 'created_at': created_at} ORDER BY seq) AS hs FROM (SELECT *, page * 86400000 AS created_at FROM page_highlights) GROUP BY doc)""",
    """SELECT n.doc, CAST(to_json({'uuid': n.uuid, 'visible_name': n.lang, 'folder_path': 'a/' || n.lang, 'doc_type': n.doc_type, 'last_modified': n.n_chars,
        'page_count': n.n_chars % 9, 'has_pdf': n.doc_type = 'pdf', 'highlights': coalesce(h.hs, []), 'error': NULL, 'warnings': [], 'tags': [n.lang],
        'page_tags': []}) AS VARCHAR) AS value FROM note_docs n LEFT JOIN h USING (doc)""",
)
def emit_results_json(t):
    docs = t("note_docs").select(
        "doc", "uuid", F.col("lang").alias("visible_name"), "doc_type", F.col("n_chars").alias("last_modified"), (F.col("n_chars") % 9).alias("page_count"),
        F.concat(F.lit("a/"), "lang").alias("folder_path"), F.array("lang").alias("tags"),
    )
    dated = t("page_highlights").withColumn("created_at", F.col("page").cast("bigint") * 86400000)
    return sidecars.emit_results_json(docs, dated)


# --- stores ----------------------------------------------------------------------------------------------------------


@query(
    "manifest_rows",
    "inventory",
    """files AS (SELECT substr(path, 8) AS path, size, mtime_s FROM inventory WHERE starts_with(path, '/store/')),
    every AS (SELECT path, size, mtime_s, FALSE AS is_dir FROM files
        UNION ALL SELECT split_part(path, '/', 1), 0, max(mtime_s), TRUE FROM files WHERE contains(path, '/') GROUP BY ALL)""",
    """SELECT path, split_part(path, '/', -1) AS name, lower(regexp_extract(split_part(path, '/', 1), '^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}')) AS uuid,
        CASE WHEN is_dir THEN '' ELSE lower(regexp_extract(split_part(path, '/', -1), '[.][^.]*$')) END AS ext, CAST(size AS BIGINT) AS size, mtime_s, is_dir
    FROM every""",
)
def manifest_rows(t):
    return store.manifest_rows(t("inventory"), "/store", "s0").drop("source_id", "side")


@query("scan_manifest")
def scan_manifest(t):
    return store.scan_manifest(t.spark, t.folder, "tables").select("name", "ext", "size", "is_dir")


@query(
    "classify_entries",
    "listing",
    "",
    """SELECT name, CASE WHEN is_dir THEN CASE WHEN name IN ('.textconversion', '.highlights', '.stfolder') THEN 'skipped folder'
            WHEN regexp_matches(name, '^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$') THEN 'keep' ELSE 'other folder' END
        WHEN name IN ('.stignore', '.local') THEN 'skipped file' WHEN contains(name, 'sync-conflict') THEN 'conflict copy'
        WHEN suffix(name, '.pagedata') THEN 'skipped ending' WHEN regexp_matches(name, '[.](metadata|content|pdf)$') THEN 'keep' ELSE 'other file' END AS reason
    FROM listing""",
)
def classify_entries(t):
    return store.classify_entries(t("listing"), include_epub=False).select("name", "reason")


@query(
    "sniff_stroke_format",
    "",
    "",
    """SELECT doc_id, CASE WHEN doc_id % 5 < 3 THEN CASE doc_id % 3 WHEN 0 THEN 'v6' WHEN 1 THEN 'v5' ELSE 'v3' END ELSE 'unknown' END AS format,
        CASE WHEN doc_id % 5 < 4 THEN CASE doc_id % 3 WHEN 0 THEN 'v6' WHEN 1 THEN 'v5' ELSE 'v3' END ELSE 'unknown' END AS seen_format,
        CASE WHEN doc_id % 5 < 3 THEN CASE doc_id % 3 WHEN 0 THEN 'scene' ELSE 'legacy' END END AS needs FROM documents""",
)
def sniff_stroke_format(t):
    magic = F.when(F.col("doc_id") % 5 < 3, store.STROKE_MAGIC).when(F.col("doc_id") % 5 == 3, "x version=").otherwise("other ")
    number = F.when(F.col("doc_id") % 3 == 0, "6").when(F.col("doc_id") % 3 == 1, "5").otherwise("3")
    files = t("documents").select("doc_id", F.concat(magic, number, F.lit("          "), F.col("text")).cast("binary").alias("content"))
    return store.sniff_stroke_format(files)


@query(
    "diff_manifests",
    "remote local",
    "",
    """SELECT r.source_id, r.path, CASE WHEN l.path IS NULL OR r.size <> l.size OR (r.ext NOT IN ('.pdf', '.epub') AND r.mtime_s > l.mtime_s)
        THEN 'fetch' ELSE 'up_to_date' END AS action
    FROM remote r LEFT JOIN local l ON r.source_id = l.source_id AND r.path = l.path AND NOT l.is_dir WHERE NOT r.is_dir""",
)
def diff_manifests(t):
    return sync.diff_manifests(t("remote"), t("local")).select("source_id", "path", "action")


@query(
    "propagate_changes",
    "remote local transfers",
    """a AS (SELECT r.*, l.path IS NULL OR r.size <> l.size OR (r.ext NOT IN ('.pdf', '.epub') AND r.mtime_s > l.mtime_s) AS due
        FROM remote r LEFT JOIN local l ON r.source_id = l.source_id AND r.path = l.path AND NOT l.is_dir WHERE NOT r.is_dir),
    changed AS (SELECT source_id, uuid, bool_or(due) AS changed FROM a WHERE ext IN ('.metadata', '.content') GROUP BY source_id, uuid),
    marked AS (SELECT DISTINCT source_id, uuid FROM transfers WHERE failed)""",
    """SELECT source_id, path, 1 AS stage FROM a WHERE due UNION ALL
    SELECT r.source_id, r.path, 0 FROM remote r LEFT JOIN changed c USING (source_id, uuid) WHERE r.is_dir AND (coalesce(c.changed, TRUE)
        OR NOT EXISTS (SELECT 1 FROM local l WHERE l.is_dir AND l.source_id = r.source_id AND l.uuid = r.uuid)
        OR EXISTS (SELECT 1 FROM marked m WHERE m.source_id = r.source_id AND m.uuid = r.uuid))""",
)
def propagate_changes(t):
    return sync.propagate_changes(t("remote"), t("local"), t("transfers").filter("failed")).select("source_id", "path", "stage")


@query(
    "hold_back",
    "transfers",
    "",
    """SELECT path FROM transfers WHERE ext NOT IN ('.metadata', '.content') OR uuid NOT IN (SELECT uuid FROM transfers WHERE failed)""",
)
def hold_back(t):
    return sync.hold_back(t("transfers")).select("path")


BACKUP = """
need AS (SELECT * FROM store_files WHERE size > 0 AND path NOT LIKE '%.cache/%'{skip}),
m AS (SELECT n.uuid, bool_and(coalesce(n.size = k.size, FALSE)) AS ok FROM need n LEFT JOIN kept_files k USING (source_id, path) GROUP BY n.uuid),
have AS (SELECT uuid, bool_or(path LIKE '%.metadata') AND bool_or(path LIKE '%.content') AND bool_or(path LIKE '%.pdf' OR path LIKE '%/p1.rm') AS ok
    FROM kept_files WHERE size > 0 GROUP BY uuid),
v AS (SELECT d.uuid, coalesce(m.ok AND have.ok, FALSE) AS verified FROM (SELECT DISTINCT uuid FROM store_files) d LEFT JOIN m USING (uuid) LEFT JOIN have USING (uuid))"""


@query("verify_backup", "store_files kept_files", BACKUP.format(skip=" AND path NOT LIKE '%.pagedata'"), "SELECT uuid, verified FROM v")
def verify_backup(t):
    return sync.verify_backup(t("store_files"), t("kept_files"), allow_skipped=True).select("uuid", "verified")


@query("verify_backup_strict", "store_files kept_files", BACKUP.format(skip=""), "SELECT uuid, verified FROM v")
def verify_backup_strict(t):
    return sync.verify_backup(t("store_files"), t("kept_files")).select("uuid", "verified")


@query(
    "select_archive_candidates",
    "entries sizes verified stores",
    """idle AS (SELECT e.source_id, e.uuid, greatest(last_opened, last_modified) AS activity, s.size FROM entries e JOIN sizes s USING (source_id, uuid) JOIN verified v USING (source_id, uuid)
        WHERE v.verified AND greatest(last_opened, last_modified) <= 20000000 AND (last_opened <> 0 OR created <= 20000000)),
    r AS (SELECT *, CAST(sum(size) OVER (PARTITION BY source_id ORDER BY activity, uuid ROWS UNBOUNDED PRECEDING) AS BIGINT) AS freed FROM idle)""",
    """SELECT r.uuid, r.activity, r.size, r.freed FROM r JOIN stores USING (source_id) WHERE 100.0 * (used - (freed - size)) / capacity >= 80""",
)
def select_archive_candidates(t):
    now = 20000000 + 7 * sync.DAY_MS
    found = sync.select_archive_candidates(t("entries"), t("sizes"), t("verified"), t("stores"), now)
    return found.select("uuid", "activity", "size", "freed")


@query(
    "collect_artifacts",
    "owned_docs owned_files registry",
    """noted AS (SELECT uuid, base_name FROM registry WHERE uuid IN (SELECT uuid FROM owned_docs)),
    bases AS (SELECT * FROM noted UNION SELECT o.uuid, o.base_name FROM owned_docs o
        WHERE NOT EXISTS (SELECT 1 FROM registry r WHERE r.base_name = o.base_name AND r.uuid <> o.uuid))""",
    """SELECT o.uuid, f.path, 'store' AS kind FROM owned_files f JOIN owned_docs o ON f.name = o.uuid || '.pdf'
    UNION ALL SELECT o.uuid, f.path, 'cache' FROM owned_files f JOIN owned_docs o ON f.name = '.render-cache-' || o.uuid || '.json'
    UNION ALL SELECT uuid, 'notes/' || base_name || '.md', 'note' FROM noted
    UNION ALL SELECT b.uuid, f.path, 'image' FROM owned_files f JOIN bases b ON b.base_name = regexp_extract(f.name, '^(.*)_p[0-9]+(_[0-9a-fA-F]{4})?[.]png([.]bak)?$', 1)
        WHERE f.name LIKE '%.png%'""",
)
def collect_artifacts(t):
    return sync.collect_artifacts(t("owned_docs"), t("owned_files"), t("note_headers")).select("uuid", "path", "kind")


# --- names -----------------------------------------------------------------------------------------------------------

NOTE_NAME = f"""coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(visible_name, '(?i)[.](pdf|epub)$', ''),
    '[\\x00-\\x1f<>:"/\\\\|?*]', '', 'g'), '[{BL}]+', ' ', 'g'), '^[{BL}]+', ''), '[{BL}]+$', ''), ''), 'Untitled')"""


@query(
    "stable_names",
    "named_docs registry",
    f"""n AS (SELECT d.uuid, r.base_name AS has, {NOTE_NAME} AS base FROM named_docs d LEFT JOIN registry r USING (uuid)),
    w AS (SELECT base, count(*) AS k FROM n WHERE has IS NULL GROUP BY base)""",
    """SELECT n.uuid, coalesce(n.has, n.base || CASE WHEN w.k > 1 OR n.base IN (SELECT has FROM n WHERE has IS NOT NULL)
        THEN ' (' || left(n.uuid, 8) || ')' ELSE '' END) AS base_name FROM n LEFT JOIN w USING (base)""",
)
def stable_names(t):
    return notes.stable_names(t("named_docs"), t("registry"))


@query(
    "image_names",
    "named_docs",
    "",
    f"""SELECT uuid, CASE WHEN trim(b) = '' THEN 'Untitled' ELSE trim(b) END || '_p1_' || right('0000' || lower(to_base(CAST(length(visible_name) AS BIGINT) * 70000 & 65535, 16)), 4) || '.png' AS image
    FROM (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(visible_name, '[<>:"/\\\\|?*]', '', 'g'),
        '[\\x1c-\\x1f\\x{{85}}{BL}]+', ' ', 'g'), '^ +', ''), ' +$', ''), '[.](pdf|PDF)$', ''), '[.](epub|EPUB)$', '') AS b FROM named_docs)""",
)
def image_names(t):
    mtime = F.length("visible_name").cast("bigint") * 70000
    image = text.page_image(text.image_name(F.col("visible_name")), F.lit(1), mtime)
    return t("named_docs").select("uuid", image.alias("image"))


@query(
    "valid_uuids",
    "listing",
    "",
    "SELECT name, regexp_matches(name, '^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$') AS is_uuid FROM listing",
)
def valid_uuids(t):
    return t("listing").select("name", ids.is_uuid(F.col("name")).alias("is_uuid"))
