"""The registered queries of the operators and the SQL they are compared with."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import audit, decontaminate, language, licenses, neardup, packing, quality, sharding, simhash, substrings, token_rollups, tokens, url_rules, whitening
from marginalia.llm.common import table
from marginalia.session import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str = ""):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


# --- 1

SHARDS, SHARD_SEED = 8, 1


@query("op1_shards")
def shards(spark, folder):
    """Whole documents go through the shuffle; the digest is taken from the shards."""
    spread = sharding.shuffle_into_shards(table(spark, folder, "documents"), SHARDS, SHARD_SEED)
    text = F.coalesce("text", F.lit(""))
    return spread.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


# --- 2

UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def benchmark_sql() -> str:
    words = f"regexp_extract_all(translate(text, '{UPPER}', '{SMALL}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
        WITH items AS (SELECT item_id, {words} AS words FROM benchmark),
        sized AS (SELECT item_id, words, CAST(least(10, len(words)) AS BIGINT) AS size FROM items WHERE len(words) > 0),
        windows AS (SELECT DISTINCT item_id, size, array_to_string(words[i + 1:i + size], ' ') AS w
            FROM (SELECT *, unnest(generate_series(0, len(words) - size)) AS i FROM sized)),
        split AS (SELECT row_number() OVER () AS r, doc_id, coalesce({words}, []) AS words FROM documents),
        spread AS (SELECT r, words, size, unnest(generate_series(0, len(words) - size)) AS i
            FROM split JOIN (SELECT DISTINCT size FROM windows) ON len(words) >= size),
        hits AS (SELECT r, i, size, item_id FROM
            (SELECT r, i, size, array_to_string(words[i + 1:i + size], ' ') AS w FROM spread) JOIN windows USING (size, w)),
        hit AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest(generate_series(i, i + size - 1)) AS place FROM hits) GROUP BY r),
        named AS (SELECT r, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids
            FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY r)
        SELECT doc_id, len(words) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items,
            sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
        FROM split LEFT JOIN hit USING (r) LEFT JOIN named USING (r)"""


@query("op2_benchmark_words", benchmark_sql())
def benchmark_words(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = decontaminate.find_benchmark(docs, table(spark, folder, "benchmark"), carry=["doc_id"])
    hit = decontaminate.hit_words(F.col("spans"))
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


# --- 3

TOKENIZER, CAPACITY, END_TOKEN = "word_bpe_49k.json", 4096, 1


@query("op3_packing")
def packed(spark, folder):
    import public_tokenizers

    docs = table(spark, folder, "documents")
    pieces = tokens.cut_documents(docs, public_tokenizers.path(TOKENIZER), CAPACITY, END_TOKEN)
    return packing.pack(pieces, CAPACITY)


# --- 4


def near_sql() -> str:
    return f"""
        WITH RECURSIVE split AS (SELECT row_number() OVER () AS r, doc_id,
            list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{SMALL}'), '[ \\x09-\\x0D]+'), lambda x: x <> '') AS words
            FROM documents),
        shingles AS (SELECT DISTINCT r, array_to_string(words[i + 1:i + 2], ' ') AS s
            FROM (SELECT r, words, unnest(generate_series(0, greatest(0, len(words) - 2))) AS i FROM split WHERE len(words) > 0)),
        sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY r),
        shared AS (SELECT a.r AS a, b.r AS b, count(*) AS n FROM shingles a JOIN shingles b USING (s) WHERE a.r < b.r GROUP BY ALL),
        links AS (SELECT a, b FROM shared JOIN sizes x ON x.r = a JOIN sizes y ON y.r = b WHERE 100 * shared.n >= 80 * (x.n + y.n - shared.n)),
        both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach(r, other) AS (SELECT r, r FROM split UNION SELECT reach.r, b FROM reach JOIN both_ways ON other = a),
        least_of AS (SELECT reach.r, min(split.doc_id) AS component_id FROM reach JOIN split ON split.r = other GROUP BY reach.r)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
        FROM split JOIN least_of USING (r) LEFT JOIN sizes USING (r)"""


@query("op4_near_duplicates", near_sql())
def near_duplicates(spark, folder):
    return neardup.near_duplicates(table(spark, folder, "documents"), words=2, percent=80)


# --- 5


def license_sql() -> str:
    known = []
    for t in licenses.TEMPLATES:
        words = t.words
        parts = {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
        known += [f"('{t.license_id}', '{s}', {t.window[0]}, {t.window[1]}, {t.shingles})" for s in sorted(parts)]
    return f"""
        WITH known(license_id, shingle, length, step, total) AS (VALUES {', '.join(known)}),
        split AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS words FROM documents),
        placed AS (SELECT r, doc_id, words, unnest(generate_series(0, greatest(0, len(words) - 5))) AS place FROM split WHERE len(words) > 0),
        shingles AS (SELECT r, doc_id, place, array_to_string(words[place + 1:place + 5], ' ') AS shingle FROM placed),
        hits AS (SELECT * FROM shingles JOIN known USING (shingle)),
        starts AS (SELECT *, unnest(generate_series(CAST(ceil(greatest(0, place - length + 1) / step) AS BIGINT) * step, place, step)) AS start FROM hits),
        windows AS (SELECT r, doc_id, license_id, start, total, count(DISTINCT shingle) AS n FROM starts GROUP BY ALL)
        SELECT doc_id, license_id, max(n) AS n_found, CAST(max(total) AS BIGINT) AS n_shingles, min(start) AS first_word,
            max(n) / max(total) AS containment
        FROM windows WHERE 100 * n >= 80 * total GROUP BY doc_id, license_id"""


@query("op5_licenses", license_sql())
def license_scan(spark, folder):
    return licenses.scan_licenses(table(spark, folder, "documents"))


# --- 6


@query("op6_languages")
def languages(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = language.learn(docs.filter(~language.held_out(F.col("doc_id"))))
    named = docs.select("doc_id", "text", language.held_out(F.col("doc_id")).alias("held_out"))
    return language.identify(named, model)


# --- 7

WORDS_SQL = "list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\x09-\\x0D]+'), lambda x: x <> '')"


def quality_sql() -> str:
    def test(rule) -> str:
        parts = [f"100 * {rule.numerator} < {rule.least} * {rule.denominator}"] if rule.least is not None else []
        parts += [f"100 * {rule.numerator} > {rule.most} * {rule.denominator}"] if rule.most is not None else []
        return "(" + " OR ".join(parts) + ")"

    named = ", ".join(f"CASE WHEN {test(r)} THEN '{r.name}' END" for r in quality.RULES)
    stop = quoted(form for w in dict.fromkeys(quality.STOP_WORDS) for form in (w, w.capitalize()))
    return f"""
        WITH split AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS whole, {WORDS_SQL} AS words,
            list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \\x09-\\x0D]')) AS lines FROM documents),
        windows AS (SELECT r, i, array_to_string(words[i + 1:i + 8], ' ') AS w
            FROM (SELECT r, words, unnest(generate_series(0, len(words) - 8)) AS i FROM split WHERE len(words) >= 8)),
        twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS n FROM windows) WHERE n > 1),
        covered AS (SELECT r, CAST(sum(least(8, coalesce(nxt - i, 8))) AS BIGINT) AS n FROM
            (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM twice) GROUP BY r),
        figures AS (SELECT doc_id, len(words) AS n_words, length(regexp_replace(whole, '[ \\x09-\\x0D]+', '', 'g')) AS word_chars,
            length(whole) - length(translate(whole, '{quality.SYMBOLS}', '')) AS n_symbols, len(lines) AS n_lines,
            len(lines) - len(list_distinct(lines)) AS n_dup_lines, length(array_to_string(lines, '')) AS line_chars,
            length(array_to_string(lines, '')) - length(array_to_string(list_distinct(lines), '')) AS dup_line_chars,
            len(list_filter(words, lambda x: regexp_matches(x, '{quality.letters_class("\\x{{{}}}")}'))) AS n_listed_words, coalesce(n, 0) AS n_repeat_words,
            len(list_filter(words, lambda x: x IN ({stop}))) AS n_stop_words,
            len(list_filter(lines, lambda x: starts_with(ltrim(x, ' '), '- ') OR starts_with(ltrim(x, ' '), '• '))) AS n_bullet_lines,
            len(list_filter(lines, lambda x: ends_with(x, '...') OR ends_with(x, '…'))) AS n_cut_lines,
            1 AS one FROM split LEFT JOIN covered USING (r)),
        judged AS (SELECT *, {' OR '.join(test(r) for r in quality.BASE_RULES)} AS base_failed,
            list_filter([{named}], lambda x: x IS NOT NULL) AS failed_rules FROM figures)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
            NOT base_failed AND len(failed_rules) = 0 AS kept, array_to_string(failed_rules, ',') AS failed_rules FROM judged"""


@query("op7_quality", quality_sql())
def quality_rules(spark, folder):
    judged = quality.judge_quality(table(spark, folder, "documents"))
    figures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", *figures, "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules"))


# --- 8


def substring_sql() -> str:
    return """
        WITH hexed AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        windows AS (SELECT r, doc_id, i, substr(h, 2 * i + 1, 100) AS w
            FROM (SELECT r, doc_id, h, unnest(generate_series(0, len(h) // 2 - 50)) AS i FROM hexed WHERE len(h) >= 100)),
        later AS (SELECT r, i FROM windows JOIN (SELECT w, min(doc_id) AS least_id FROM windows GROUP BY w) USING (w) WHERE doc_id > least_id),
        marked AS (SELECT r, i, coalesce(i > lag(i) OVER (PARTITION BY r ORDER BY i) + 50, true) AS fresh FROM later),
        numbered AS (SELECT r, i, sum(CAST(fresh AS INT)) OVER (PARTITION BY r ORDER BY i) AS span FROM marked),
        spans AS (SELECT r, span, min(i) AS a, max(i) + 50 AS b FROM numbered GROUP BY r, span),
        gaps AS (SELECT r, span, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM spans),
        cut AS (SELECT r, count(*) AS n, CAST(sum(b - a) AS BIGINT) AS removed, max(b) AS stop,
            string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head FROM gaps JOIN hexed USING (r) GROUP BY r)
        SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(n, 0) AS n_spans,
            sha256(unhex(coalesce(head || substr(h, 2 * stop + 1), h))) AS kept_sha256
        FROM hexed LEFT JOIN cut USING (r)"""


@query("op8_substrings", substring_sql())
def substring_dedup(spark, folder):
    docs = table(spark, folder, "documents")
    cut = substrings.duplicate_spans(docs, 50, carry=["doc_id"])
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    spans = F.size("spans").cast("long")
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), spans.alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


# --- 9

CLEAN = "[#*$%&|<>]"


def rollup_sql() -> str:
    def count(text, pattern):
        return f"len(regexp_extract_all({text}, '{pattern}'))"

    rows = []
    for version, pattern in token_rollups.VERSIONS.items():
        clean = f"regexp_replace(text, '{CLEAN}', '', 'g')"
        rows.append(f"SELECT source, lang, '{version}' AS tokenizer_version, coalesce({count(clean, pattern)}, 0) AS tokens FROM live")
    return f"""
        WITH live AS (SELECT * FROM documents WHERE coalesce(len(regexp_extract_all(text, '{token_rollups.VERSIONS["blank-1"]}')), 0) >= 5)
        SELECT source, lang, tokenizer_version, count(*) AS documents, CAST(sum(tokens) AS BIGINT) AS tokens
        FROM ({' UNION ALL '.join(rows)}) GROUP BY ALL"""


@query("op9_token_rollups", rollup_sql())
def rollups(spark, folder):
    """Three batches over all documents: load, recount of the texts that symbols are stripped from, deletion of stubs
    of under five words; the second batch arrives twice."""
    docs = table(spark, folder, "documents")
    none = F.lit(None).cast(token_rollups.SIDE)
    clean = F.regexp_replace("text", CLEAN, "")
    before, after = token_rollups.counted(docs, F.col("text"), "b"), token_rollups.counted(docs, clean, "a")
    stub = token_rollups.token_count(F.col("text"), token_rollups.VERSIONS["blank-1"]) < 5
    loaded = docs.select(F.explode(before).alias("after")).select(none.alias("before"), "after")
    marked = docs.filter(F.col("text").rlike(CLEAN))
    revised = marked.select(F.explode(F.arrays_zip(before, after)).alias("c")).select(F.col("c.b").alias("before"), F.col("c.a").alias("after"))
    gone = docs.filter(stub).select(F.explode(after).alias("before")).select("before", none.alias("after"))
    state = token_rollups.Rollups(spark, f"{shared_folder(spark).rstrip('/')}/token-rollups-{uuid.uuid4().hex}")
    for number, changes in ((1, loaded), (2, revised), (2, revised), (3, gone)):
        state.apply(number, changes)
    return state.totals()


# --- 10


def url_sql() -> str:
    rules = url_rules.HOST_RULES + url_rules.PATTERN_RULES
    values = ", ".join(f"({quoted([r.name, url_rules.regex(r.pattern), r.verdict])}, {r.rank})" for r in rules)
    rest = "CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END"
    return f"""
        WITH rules(rule, regex, verdict, rank) AS (VALUES {values}),
        cut AS (SELECT row_number() OVER () AS r, page_id, coalesce({rest}, '') AS rest FROM pages),
        parsed AS (SELECT r, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{SMALL}') AS host,
            regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
        best AS (SELECT r, arg_max(rule, (rank, rule)) AS rule, arg_max(verdict, (rank, rule)) AS verdict
            FROM parsed JOIN rules ON regexp_matches(host || path, regex) GROUP BY r)
        SELECT page_id, host, path, CASE WHEN rule IN ({quoted(r.name for r in url_rules.HOST_RULES)}) THEN rule END AS rule,
            CASE WHEN rule IN ({quoted(r.name for r in url_rules.PATTERN_RULES)}) THEN rule END AS pattern,
            coalesce(verdict, 'allow') AS verdict FROM parsed LEFT JOIN best USING (r)"""


@query("op10_url_rules", url_sql())
def urls(spark, folder):
    """``rule`` is the host rule that decides, ``pattern`` the pattern rule that does where no host rule fits."""
    judged = url_rules.judge_urls(table(spark, folder, "pages"))
    by_host = F.col("rule").isin([r.name for r in url_rules.HOST_RULES])
    rule, pattern = F.when(by_host, F.col("rule")), F.when(~by_host, F.col("rule"))
    return judged.select("page_id", "host", "path", rule.alias("rule"), pattern.alias("pattern"), "verdict")


# --- 11


@query("op11_simhash")
def simhash_duplicates(spark, folder):
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", simhash.as_hex(F.col("fingerprint")).alias("fingerprint"), "component_id")


# --- 12


@query("op12_whitening")
def whitened(spark, folder):
    return whitening.whiten(table(spark, folder, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))


# --- 13


def audit_sql() -> str:
    names = ", ".join(f"('{f}')" for f in audit.FILTERS)
    order = " JOIN ".join(["names n1"] + [f"names n{i} ON n{i}.f NOT IN ({', '.join(f'n{k}.f' for k in range(1, i))})" for i in range(2, 6)])
    return f"""
        WITH names(f) AS (VALUES {names}),
        orders AS (SELECT n1.f || n2.f || n3.f || n4.f || n5.f AS filter_order FROM {order}),
        split AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS whole, {WORDS_SQL} AS words,
            min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
        marks AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
        judged AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
            CASE WHEN len(words) < {audit.MIN_WORDS} THEN 'A' ELSE '' END
            || CASE WHEN 100 * len(list_distinct(words)) < {audit.MIN_DISTINCT_PERCENT} * len(words) THEN 'B' ELSE '' END
            || CASE WHEN 100 * (length(whole) - length(translate(whole, '{UPPER}', ''))) > {audit.MAX_CAPITAL_PERCENT} * length(whole) THEN 'C' ELSE '' END
            || CASE WHEN translate(whole, '{audit.SYMBOLS}', '') <> whole THEN 'D' ELSE '' END
            || CASE WHEN doc_id > least THEN 'E' ELSE '' END AS fails FROM split LEFT JOIN marks USING (doc_id)),
        patterns AS (SELECT part, fails, good, toxic, count(*) AS n FROM judged GROUP BY ALL),
        steps AS (SELECT filter_order, CAST(s AS INTEGER) AS step, filter_order[s] AS own, filter_order[1:s - 1] AS earlier
            FROM orders, generate_series(1, 5) AS g(s)),
        met AS (SELECT part, filter_order, step, own, fails, n, good, toxic, contains(fails, own) AS failing,
            translate(fails, earlier, '') <> fails AS gone FROM patterns, steps),
        counted AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT failing AND NOT gone), 0) AS kept,
            coalesce(sum(n) FILTER (failing AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (failing AND gone), 0) AS redundant,
            coalesce(sum(n) FILTER (fails = own), 0) AS unique_fails, coalesce(sum(n) FILTER (failing AND NOT gone AND good), 0) AS good_lost,
            coalesce(sum(n) FILTER (failing AND NOT gone AND toxic), 0) AS toxic_lost FROM met GROUP BY ALL)
        SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
            CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
            CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM counted"""


@query("op13_filter_audit", audit_sql())
def filter_audit(spark, folder):
    return audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))
