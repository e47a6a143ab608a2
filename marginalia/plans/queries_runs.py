"""Queries over runs, fleets and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.functions import text
from marginalia.operators import catalog, fleet, merge, review, runs, tree
from marginalia.plans.bindings import run_arrivals, run_files, streamed
from marginalia.plans.queries_catalog import FOLDERS, PATHS, TRASH
from marginalia.plans.queries_notes import ORDER, STATE
from marginalia.plans.queries_pages import RUNS
from marginalia.plans.registry import query
from marginalia.streaming import changes as feeds
from marginalia.streaming.run import new_folder, newest_rows, run_to_table, to_folder


@query(
    "recent_documents",
    "entries contents fragments fragment_gutters",
    TRASH + "," + FOLDERS.format(source="live") + "," + PATHS + "," + RUNS.format(source="fragments")
    + """,
    counts AS (SELECT '00000000-0000-4000-8000-' || lpad(CAST(doc AS VARCHAR), 12, '0') AS uuid, count(*) AS highlights FROM merged GROUP BY doc)""",
    """SELECT p.uuid, p.folder_path, p.last_modified, coalesce(h.highlights, 0) AS highlights FROM paths p JOIN contents c USING (source_id, uuid) LEFT JOIN counts h USING (uuid)
    WHERE p.entry_type <> 'CollectionType' AND NOT c.is_corrupt""",
)
def recent_documents(t):
    """Live documents with folder path and number of merged highlights, newest first."""
    placed = tree.resolve_folder_paths(t("entries"), live=True)
    ready = catalog.classify_readiness(placed, t("contents")).filter(F.col("readiness") == "ready")
    number = F.lpad(F.col("doc").cast("string"), 12, "0")
    counts = merge.merge_fragments(t("fragments"), t("fragment_gutters")).groupBy("doc").agg(F.count(F.lit(1)).alias("highlights"))
    counts = counts.select(F.concat(F.lit("00000000-0000-4000-8000-"), number).alias("uuid"), "highlights")
    joined = ready.join(counts, "uuid", "left").select("uuid", "folder_path", "last_modified", F.coalesce("highlights", F.lit(0)).alias("highlights"))
    return joined.orderBy(F.desc("last_modified"), "uuid")


# --- runs ------------------------------------------------------------------------------------------------------------

COUNTERS = """count(*) AS documents_processed, count(*) FILTER (n_highlights > 0 AND output_file IS NOT NULL) AS documents_with_highlights,
    CAST(coalesce(sum(n_highlights) FILTER (output_file IS NOT NULL), 0) AS BIGINT) AS total_highlights, count(output_file) AS output_files, count(error) AS errors"""


@query(
    "run_summary",
    "run_documents",
    "",
    f"SELECT source_id, {COUNTERS} FROM run_documents GROUP BY source_id UNION ALL SELECT 'all', {COUNTERS} FROM run_documents",
)
def run_summary(t):
    return runs.run_summary(t("run_documents"))


NEXT = """
seen AS (SELECT source_id, max(last_modified) FILTER (readiness = 'ready') AS observed, count(*) FILTER (readiness <> 'ready') AS pending FROM {docs} GROUP BY source_id),
j AS (SELECT p.source_id, p.current_hash, v.cursor_ms, v.path_hash, s.observed, coalesce(r.full_scan AND r.clean_transfer AND r.errors = 0, FALSE) AND coalesce(s.pending, 0) = 0 AS clean
    FROM source_paths p LEFT JOIN source_prev v USING (source_id) LEFT JOIN source_runs r USING (source_id) LEFT JOIN seen s USING (source_id)),
advanced AS (SELECT source_id, CASE WHEN clean THEN greatest(coalesce(cursor_ms, 0), coalesce(observed, 0)) ELSE cursor_ms END AS cursor_ms,
    CASE WHEN clean THEN current_hash ELSE path_hash END AS path_hash, clean AS advanced FROM j)"""


@query("next_cursor", "cursor_docs source_runs source_prev source_paths", NEXT.format(docs="cursor_docs"), "SELECT * FROM advanced")
def next_cursor(t):
    return runs.next_cursor(t("cursor_docs"), t("source_runs"), t("source_prev"), t("source_paths"))


@query(
    "run_cursors",
    "source_prev source_paths",
    "",
    "SELECT source_id, CASE WHEN path_hash = current_hash THEN cursor_ms END AS cursor_ms FROM source_paths LEFT JOIN source_prev USING (source_id)",
)
def run_cursors(t):
    return runs.run_cursors(t("source_prev"), t("source_paths"))


@query(
    "pending_hold",
    "entries contents",
    """r AS (SELECT e.source_id, last_modified, CASE WHEN c.uuid IS NULL OR c.is_corrupt THEN 1 ELSE 0 END AS pending FROM entries e LEFT JOIN contents c USING (source_id, uuid)
        WHERE entry_type <> 'CollectionType')""",
    "SELECT source_id, CASE WHEN sum(pending) > 0 THEN 5 ELSE max(last_modified) END AS cursor_ms, sum(pending) = 0 AS advanced FROM r GROUP BY source_id",
)
def pending_hold(t):
    one = t("entries").select("source_id").distinct()
    clean = one.select("source_id", F.lit(True).alias("full_scan"), F.lit(0).alias("errors"), F.lit(True).alias("clean_transfer"))
    prev = one.select("source_id", F.lit(5).cast("bigint").alias("cursor_ms"), F.lit("h").alias("path_hash"))
    held = feeds.pending_hold(t("entries"), t("contents"), clean, prev, one.withColumn("current_hash", F.lit("h")))
    return held.select("source_id", "cursor_ms", "advanced")


def cache_sql(reported: str) -> str:
    fresh = "i.filename = c.filename AND i.rm_mtime = c.rm_mtime AND i.template IS NOT DISTINCT FROM c.template AND i.output_exists"
    return f"""
    a AS (SELECT i.doc, i.page_id, i.filename, c.ocr_text, CASE WHEN NOT coalesce({fresh}, FALSE) THEN 'recompute' WHEN {reported} AND c.ocr_text IS NULL THEN 'ocr_only' ELSE 'reuse' END AS action
        FROM cache_inputs i LEFT JOIN cache_rows c ON i.doc = c.doc AND i.page_id = c.page_id AND c.settings = 'now')"""


CACHE_ROWS = "SELECT doc, page_id, filename, action, CASE WHEN action = 'reuse' AND {0} THEN ocr_text ELSE '' END AS reported_ocr FROM a"


@query("page_cache_plan", "cache_inputs cache_rows", cache_sql("FALSE"), CACHE_ROWS.format("FALSE"))
def page_cache_plan(t):
    return runs.page_cache_plan(t("cache_inputs"), t("cache_rows"), "now")


@query("page_cache_plan_with_ocr", "cache_inputs cache_rows", cache_sql("TRUE"), CACHE_ROWS.format("TRUE"))
def page_cache_plan_with_ocr(t):
    return runs.page_cache_plan(t("cache_inputs"), t("cache_rows"), "now", ocr_on=True)


@query(
    "relative_times",
    "library",
    "",
    """SELECT uuid, CASE WHEN last_modified IS NULL OR last_modified = 0 OR m < 1 THEN 'just now' WHEN m < 60 THEN m || 'm ago' WHEN h < 24 THEN h || 'h ago' ELSE d || 'd ago' END AS age
    FROM (SELECT uuid, last_modified, CAST(floor(g / 60000) AS BIGINT) AS m, CAST(floor(g / 3600000) AS BIGINT) AS h, CAST(floor(g / 86400000) AS BIGINT) AS d
        FROM (SELECT uuid, last_modified, 4000000000 - last_modified * 1000 AS g FROM library))""",
)
def relative_times(t):
    return t("library").select("uuid", text.relative_time(F.col("last_modified"), F.lit(4000000000)).alias("age"))


LONG_NOW = (365 + 40) * 86400000


@query(
    "relative_times_long",
    "library",
    f"""e AS (SELECT uuid, CASE highlight_count WHEN 4 THEN NULL WHEN 3 THEN 0 ELSE {LONG_NOW // 1000} - last_modified % 4000000 END AS epoch FROM library),
    g AS (SELECT uuid, epoch, {LONG_NOW // 1000} - epoch AS s, make_timestamp(epoch * 1000000) AS ts FROM e)""",
    """SELECT uuid, CASE WHEN coalesce(epoch, 0) = 0 THEN 'Never' WHEN s < 60 THEN 'Just now' WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 86400 THEN (s // 3600) || 'h ago'
        WHEN s // 86400 = 1 THEN 'Yesterday' WHEN s // 86400 < 7 THEN (s // 86400) || 'd ago' WHEN s // 86400 < 30 THEN (s // 604800) || 'w ago'
        WHEN year(ts) = 1971 THEN strftime(ts, '%b %-d') ELSE strftime(ts, '%b %-d, %Y') END AS age FROM g""",
)
def relative_times_long(t):
    """Ages up to 46 days, seen from 10 February 1971, some unknown."""
    epoch = F.lit(LONG_NOW // 1000) - F.col("last_modified") % 4000000
    epoch = F.when(F.col("highlight_count") == 4, F.lit(None)).when(F.col("highlight_count") == 3, F.lit(0)).otherwise(epoch)
    return t("library").select("uuid", text.relative_time(epoch, F.lit(LONG_NOW), "long").alias("age"))


# --- fleets ----------------------------------------------------------------------------------------------------------

STREAKS = """
c AS (SELECT *, count(*) FILTER (NOT failed) OVER (PARTITION BY key ORDER BY ts, seq) AS island FROM outcomes),
streaks AS (SELECT key, ts, seq, failed, count(*) FILTER (failed) OVER (PARTITION BY key, island ORDER BY ts, seq) AS streak FROM c)"""


@query("failure_streaks", "outcomes", STREAKS, "SELECT key, seq, streak, failed AND streak = 3 AS alert FROM streaks")
def failure_streaks(t):
    return fleet.failure_streaks(t("outcomes"), 3, "key", ("ts", "seq")).select("key", "seq", "streak", "alert")


REDACTED = (
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)(X-API-Key:\\s*)[^''\"\\s]+', '\\1***', 'g'), "
    "'(SSHPASS=)\\S+', '\\1***', 'g'), '(sshpass\\s+-p\\s*)\\S+', '\\1***', 'g'), '(?i)(--password[=\\s]+)\\S+', '\\1***', 'g')"
)


@query("redact_secrets", "log_text", "", f"SELECT id, {REDACTED} AS text FROM log_text")
def redact_secrets(t):
    return fleet.redact_secrets(t("log_text"), ["text"])


HEALTH = """
d AS (SELECT * REPLACE (coalesce(nullif(trim(model), ''), CASE WHEN mem_total_mb < 600 THEN 'model1' WHEN mem_total_mb < 1200 THEN 'model2' ELSE 'unknown' END) AS model) FROM devices),
v AS (SELECT d.*, regexp_matches(fw, '^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$') AS ok, TRY_CAST(split_part(fw, '.', 1) AS INTEGER) AS a, TRY_CAST(split_part(fw, '.', 2) AS INTEGER) AS b,
    g.sync_memory_mb AS sm, g.min_free_memory_mb AS mm, g.min_free_storage_mb AS ms FROM d
    JOIN budgets g ON g.model = CASE WHEN d.model IN ('model1', 'model2') THEN d.model ELSE 'unknown' END),
c AS (SELECT device_id, 'firmware' AS "check", ok AND (a > 2 OR a = 2 AND b >= 6) AS passed,
        CASE WHEN NOT (ok AND (a > 2 OR a = 2 AND b >= 6)) THEN 'error' WHEN a = 3 AND b <= 26 THEN 'info' ELSE 'warning' END AS severity FROM v
    UNION ALL SELECT device_id, 'memory', mem_avail_mb >= mm, CASE WHEN mem_avail_mb < mm THEN 'error' WHEN mem_avail_mb < mm + sm THEN 'warning' ELSE 'info' END FROM v
    UNION ALL SELECT device_id, 'home_storage', has_home AND home_avail_mb >= ms, CASE WHEN has_home AND home_avail_mb >= ms THEN 'info' ELSE 'error' END FROM v
    UNION ALL SELECT device_id, 'root_partition', TRUE, CASE WHEN root_used > 95 THEN 'warning' ELSE 'info' END FROM v
    UNION ALL SELECT device_id, 'store', store_exists, CASE WHEN store_exists THEN 'info' ELSE 'error' END FROM v
    UNION ALL SELECT device_id, 'model', TRUE, 'warning' FROM v
    UNION ALL SELECT device_id, 'installation_path', FALSE, 'error' FROM v WHERE NOT (ok AND (a > 2 OR a = 2 AND b >= 6)))"""


def devices_with_storage(t):
    def part(path, free, used):
        return F.struct(F.lit(path).alias("mount"), F.col(free).alias("avail_mb"), used.alias("used_pct"))

    root, home = part("/", "home_avail_mb", F.col("root_used")), part("/home", "home_avail_mb", F.lit(70))
    return t("devices").withColumn("storage", F.when(F.col("has_home"), F.array(root, home)).otherwise(F.array(root)))


@query(
    "device_health",
    "devices budgets",
    HEALTH,
    """SELECT device_id, bool_and(passed OR severity <> 'error') OVER (PARTITION BY device_id) AS device_passed, "check", passed, severity FROM c""",
)
def device_health(t):
    return fleet.device_health(devices_with_storage(t), t("budgets"))


@query(
    "version_support",
    "devices",
    """v AS (SELECT device_id, regexp_matches(fw, '^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$') AS ok, TRY_CAST(split_part(fw, '.', 1) AS INTEGER) AS a,
        TRY_CAST(split_part(fw, '.', 2) AS INTEGER) AS b FROM devices)""",
    """SELECT device_id, CASE WHEN NOT ok THEN 'malformed' WHEN a < 2 OR a = 2 AND b < 6 THEN 'unsupported' WHEN a = 3 AND b <= 26 THEN 'tested'
        WHEN a > 3 OR a = 3 AND b >= 26 THEN 'newer' ELSE 'older' END AS support,
        CASE WHEN NOT ok OR a < 2 OR a = 2 AND b < 6 THEN NULL WHEN a > 3 OR a = 3 AND b >= 4 THEN 'entware' ELSE 'toltec' END AS install_path FROM v""",
)
def version_support(t):
    return fleet.version_support(t("devices")).select("device_id", "support", "install_path")


# --- streams ---------------------------------------------------------------------------------------------------------

QUIET = """
kept AS (SELECT * FROM changes WHERE regexp_matches(path, '[.](rm|metadata|content)$') AND NOT contains(path, 'sync-conflict') AND left(path, 36) NOT IN (SELECT uuid FROM ignored)),
gaps AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY source_id ORDER BY ts) + INTERVAL 600 SECONDS THEN 0 ELSE 1 END AS starts FROM kept),
periods AS (SELECT *, sum(starts) OVER (PARTITION BY source_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM gaps)"""
QUIET_ROWS = """SELECT source_id, epoch_us(min(ts)) AS first_us, epoch_us(max(ts) + INTERVAL 600 SECONDS) AS due_us, count(*) AS changes FROM periods GROUP BY source_id, k"""


def as_micros(df):
    return df.select("source_id", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("due_ts").alias("due_us"), "changes")


@query("debounced_changes", "changes ignored", QUIET, QUIET_ROWS)
def debounced_changes(t):
    return as_micros(feeds.debounced_changes(t("changes"), t("ignored"), 600))


@query("debounced_changes_stream", "changes ignored", QUIET, QUIET_ROWS)
def debounced_changes_stream(t):
    ignored = t("ignored")
    stream = feeds.debounced_changes(streamed(t, "events", "changes"), ignored, 600)
    return as_micros(run_to_table(stream, "complete", new_folder(t.spark)))


@query(
    "debounced_changes_append",
    "changes ignored",
    QUIET,
    QUIET_ROWS + " HAVING max(ts) + INTERVAL 600 SECONDS <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM kept)",
)
def debounced_changes_append(t):
    """In append mode: each quiet period once, when the watermark of 10 minutes has passed it."""
    folder, ignored = new_folder(t.spark), t("ignored")
    arriving = t("changes").withColumn("part", F.floor(F.dayofmonth("ts") / 10))
    handle = to_folder(f"{folder}/due")
    run_arrivals(arriving, "part", folder, handle, lambda rows: feeds.debounced_changes(rows.drop("part"), ignored, 600))
    return as_micros(t.spark.read.parquet(f"{folder}/due"))


@query("dedupe_highlights_stream", "review_events", "", "SELECT DISTINCT highlight_id AS id FROM review_events")
def dedupe_highlights_stream(t):
    """In batches whose times lie days apart, each with identifiers of the ones before."""
    folder = new_folder(t.spark)
    found = t("review_events").select(F.col("highlight_id").alias("id"), "ts", F.floor(F.dayofmonth("ts") / 10).alias("part"))
    run_arrivals(found, "part", folder, feeds.publish_new_highlights(f"{folder}/published"))
    return t.spark.read.parquet(f"{folder}/published").select("id")


@query("review_state_stream", "review_events", STATE, "SELECT highlight_id, status, edited_text FROM state")
def review_state_stream(t):
    """In four batches, each merged into the buckets of the state that it touches."""
    folder, events = new_folder(t.spark), t("review_events")
    arriving = events.withColumn("part", F.floor(F.dayofmonth("ts") / 10))
    run_arrivals(arriving, "part", folder, feeds.keep_review_state(f"{folder}/state", ORDER))
    return feeds.review_state(events, f"{folder}/state", ORDER)


@query("review_state_updates", "review_events", STATE, "SELECT highlight_id, status, edited_text FROM state")
def review_state_updates(t):
    """In update mode: each batch hands on the highlights it changed, the table keeps the last row of each."""
    folder = new_folder(t.spark)
    arriving = t("review_events").withColumn("part", F.floor(F.dayofmonth("ts") / 10))
    handle = to_folder(f"{folder}/state")
    run_arrivals(arriving, "part", folder, handle, lambda events: review.reduce_review(events, ORDER), "update")
    return newest_rows(t.spark, f"{folder}/state", ["highlight_id"]).select("highlight_id", "status", "edited_text")


@query("streak_alerts_stream", "outcomes", STREAKS, "SELECT key, epoch_us(ts) AS at_us, streak FROM streaks WHERE failed AND streak = 3")
def streak_alerts_stream(t):
    """In three batches, one after the other in time, so that outages go on from one to the next."""
    folder = new_folder(t.spark)
    arriving = t("outcomes").withColumn("part", F.floor(F.dayofmonth("ts") / 11))
    run_files(arriving, "part", folder, to_folder(f"{folder}/alerts"), feeds.streak_alerts, "update")
    alerts = t.spark.read.parquet(f"{folder}/alerts")
    return alerts.select("key", F.unix_micros("ts").alias("at_us"), "streak")


# Cursors move at the end of any batch after which no document of the source waits.
UPKEEP = """
steps AS (SELECT DISTINCT arrival AS step FROM upkeep_arrivals),
late AS (SELECT uuid, max(arrival) AS done FROM upkeep_arrivals WHERE readiness = 'ready' GROUP BY uuid),
seen AS (SELECT step, source_id, max(last_modified) FILTER (readiness = 'ready') AS observed,
        count(*) FILTER (readiness <> 'ready' AND (done IS NULL OR done > step)) AS waiting
    FROM steps JOIN upkeep_arrivals ON arrival <= step LEFT JOIN late USING (uuid) GROUP BY step, source_id),
moved AS (SELECT source_id, max(observed) AS observed FROM seen JOIN source_runs r USING (source_id)
    WHERE waiting = 0 AND r.full_scan AND r.clean_transfer AND r.errors = 0 GROUP BY source_id)"""


@query(
    "incremental_upkeep",
    "upkeep_arrivals source_runs source_prev source_paths",
    UPKEEP,
    """SELECT 'cursor' AS part, source_id, CASE WHEN observed IS NULL THEN cursor_ms ELSE greatest(coalesce(cursor_ms, 0), observed) END AS value,
        CAST(1 AS BIGINT) AS n FROM source_paths LEFT JOIN source_prev USING (source_id) LEFT JOIN moved USING (source_id)
    UNION ALL SELECT 'published', source_id, last_modified, count(*) FROM upkeep_arrivals LEFT JOIN source_prev USING (source_id)
        WHERE readiness = 'ready' AND (cursor_ms IS NULL OR last_modified > cursor_ms) GROUP BY source_id, last_modified""",
)
def incremental_upkeep(t):
    """Five batches; documents arrive out of order, some not ready, of those some ready in a later batch."""
    folder, outcome = new_folder(t.spark), t("source_runs")

    def publish(due, number):
        due.write.mode("overwrite").parquet(f"{folder}/published/batch={number}")
        return outcome

    arriving = t("upkeep_arrivals").withColumn("doc_type", F.lit("pdf"))
    run_arrivals(arriving, "arrival", folder, feeds.incremental_upkeep(folder, publish, t("source_prev"), t("source_paths")))
    last = F.max_by("cursor_ms", "batch").alias("value")
    cursors = t.spark.read.parquet(f"{folder}/cursors").groupBy("source_id").agg(last)
    cursors = cursors.select(F.lit("cursor").alias("part"), "source_id", "value", F.lit(1).cast("bigint").alias("n"))
    published = t.spark.read.parquet(f"{folder}/published").groupBy("source_id", F.col("last_modified").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return cursors.unionByName(published.withColumn("part", F.lit("published")))
