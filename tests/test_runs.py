"""Review state, runs, fleets, streams, plan shapes."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from marginalia.operators import fleet, review, runs
from marginalia.streaming import changes as feeds
from marginalia.plans.bindings import run_arrivals
from marginalia.streaming.buckets import Buckets, path_and_files
from marginalia.streaming.run import SETTINGS, new_folder, run_to_table, stream_settings, to_folder


def at(seconds):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=seconds)


def test_review(spark):
    events = [
        ("a", 1, "accept", None), ("b", 1, "accept", "new"), ("c", 1, "accept", "kept"), ("c", 2, "dismiss", None), ("d", 1, "accept", "x"), ("d", 2, "undo", None),
        ("e", 1, "dismiss", None), ("f", 1, "undo", None), ("f", 2, "accept", None), ("f", 0, "accept", "old"),
    ]
    df = spark.createDataFrame([(h, at(t), a, e) for h, t, a, e in events], "highlight_id string, ts timestamp, action string, edited_text string")
    state = review.reduce_review(df)
    assert {r.highlight_id: (r.status, r.edited_text) for r in state.collect()} == {
        "a": ("accepted", None), "b": ("edited", "new"), "c": ("dismissed", "kept"), "d": ("pending", None), "e": ("dismissed", None), "f": ("accepted", None),
    }
    highlights = spark.createDataFrame([("u", h) for h in "abcdefg"], "uuid string, id string")
    assert {r.id for r in review.pending_review(highlights, state).collect()} == set("cdeg")
    assert tuple(review.review_summary(review.with_review_state(highlights, state)).first()) == (1, 2, 3, 2)


CURSOR_CASES = {
    "clean": ((True, 0, True), "ready", "same", 9),
    "older": ((True, 0, True), "ready", "same", 100),
    "pending": ((True, 0, True), "pending_missing", "same", 5),
    "errors": ((True, 2, True), "ready", "same", 5),
    "targeted": ((False, 0, True), "ready", "same", 5),
    "transfer": ((True, 0, False), "ready", "same", 5),
    "no run": (None, "ready", "same", 5),
    "first": ((True, 0, True), "ready", None, 9),
    "moved": ((True, 0, True), "ready", "other", 9),
}


def test_cursors(spark):
    docs = [(k, t, s if t == 3 else "ready") for k, (_, s, _, _) in CURSOR_CASES.items() for t in (9, 3)]
    outcome = [(k, *r) for k, (r, _, _, _) in CURSOR_CASES.items() if r]
    before = [(k, 100 if k == "older" else 5, p) for k, (_, _, p, _) in CURSOR_CASES.items() if p]
    df = runs.next_cursor(
        spark.createDataFrame(docs, "source_id string, last_modified bigint, readiness string"),
        spark.createDataFrame(outcome, "source_id string, full_scan boolean, errors int, clean_transfer boolean"),
        spark.createDataFrame(before, "source_id string, cursor_ms bigint, path_hash string"),
        spark.createDataFrame([(k, "same") for k in CURSOR_CASES], "source_id string, current_hash string"),
    )
    found = {r.source_id: r for r in df.collect()}
    assert {k: r.cursor_ms for k, r in found.items()} == {k: c for k, (_, _, _, c) in CURSOR_CASES.items()}
    assert found["moved"].path_hash == "same" and found["first"].path_hash == "same"


def test_run_cursors(spark):
    prev = spark.createDataFrame([("a", 5, "h"), ("b", 5, "old")], "source_id string, cursor_ms bigint, path_hash string")
    paths = spark.createDataFrame([("a", "h"), ("b", "h"), ("c", "h")], "source_id string, current_hash string")
    assert {r.source_id: r.cursor_ms for r in runs.run_cursors(prev, paths).collect()} == {"a": 5, "b": None, "c": None}


def test_page_cache(spark):
    inputs = spark.createDataFrame([("d", p, "f", 1, t, e) for p, t, e in [("same", "x", True), ("blank", None, True), ("gone", "x", False), ("new", "x", True), ("unread", "x", True)]], "doc string, page_id string, filename string, rm_mtime bigint, template string, output_exists boolean")
    cache = spark.createDataFrame([("d", p, "f", 1, t, o, "s") for p, t, o in [("same", "x", "read"), ("blank", None, "read"), ("gone", "x", "read"), ("unread", "x", None)]], "doc string, page_id string, filename string, rm_mtime bigint, template string, ocr_text string, settings string")

    def plan(settings, ocr):
        return {r.page_id: (r.action, r.reported_ocr) for r in runs.page_cache_plan(inputs, cache, settings, ocr).collect()}

    assert plan("s", True) == {"same": ("reuse", "read"), "blank": ("reuse", "read"), "gone": ("recompute", ""), "new": ("recompute", ""), "unread": ("ocr_only", "")}
    assert plan("s", False)["same"] == ("reuse", "") and plan("s", False)["unread"] == ("reuse", "")
    assert {a for a, _ in plan("changed", True).values()} == {"recompute"}


@pytest.mark.parametrize("limit", [1000, 5])
def test_streaks(spark, limit):
    outcomes = "fffsffffffsf"
    rows = [("k", i, c == "f") for i, c in enumerate(outcomes)] + [("j", 0, True)]
    df = spark.createDataFrame(rows, "key string, ts bigint, failed boolean")
    found = fleet.failure_streaks(df, 3, limit=limit).filter("key = 'k'").orderBy("ts").collect()
    assert [r.streak for r in found] == [1, 2, 3, 0, 1, 2, 3, 4, 5, 6, 0, 1]
    assert [r.ts for r in found if r.alert] == [2, 6]


def test_streaks_over_batches(spark):
    """Outages that go on over batches, end in a later one, and start anew; a key without outage has no state."""
    batches = [("ff", "s"), ("f", ""), ("fsff", "ss"), ("f", "f"), ("", "ff"), ("s", "f")]
    rows, clock = [], 0
    for part, outcomes in enumerate(batches):
        for key, text in zip((1, None), outcomes):
            rows += [(key, at(clock + i), i, c == "f", part) for i, c in enumerate(text)]
        clock += 10
    df = spark.createDataFrame(rows, "key bigint, ts timestamp, seq int, failed boolean, part int")
    folder = new_folder(spark)
    run_arrivals(df, "part", folder, to_folder(f"{folder}/alerts"), feeds.streak_alerts, "update")
    found = {(r.key, r.ts) for r in spark.read.parquet(f"{folder}/alerts").collect()}
    assert found == {(1, at(10)), (1, at(30)), (None, at(41))}
    batch = df.na.fill(2, ["key"])
    assert found == {(None if r.key == 2 else r.key, r.ts) for r in fleet.failure_streaks(batch, 3, "key", ("ts", "seq")).filter("alert").collect()}


def test_state_settings_are_those_of_the_caller_afterwards(spark):
    before = {name: spark.conf.get(name, None) for name in SETTINGS}
    with stream_settings(spark):
        assert all(spark.conf.get(name) == value for name, value in SETTINGS.items())
    assert {name: spark.conf.get(name, None) for name in SETTINGS} == before


def test_redaction(spark):
    cases = {
        "X-API-Key: abc123 x": "X-API-Key: *** x",
        "curl -H 'x-api-key: abc' u": "curl -H 'x-api-key: ***' u",
        "SSHPASS=hunter2 rsync ...": "SSHPASS=*** rsync ...",
        "sshpass -p hunter2 ssh": "sshpass -p *** ssh",
        "--password hunter2": "--password ***",
        "--password=hunter2": "--password=***",
        "ordinary text": "ordinary text",
    }
    df = spark.createDataFrame([(k, k) for k in cases], "id string, text string")
    assert {r.id: r.text for r in fleet.redact_secrets(df, ["text"]).collect()} == cases


def test_devices(spark):
    schema = "device_id string, model string, fw string, mem_total_mb int, mem_avail_mb int, storage array<struct<mount:string,total_mb:int,avail_mb:int,used_pct:int>>, store_exists boolean"
    disks = [("/", 200, 60, 70), ("/home", 6000, 4300, 28)]
    devices = spark.createDataFrame([("ok", "model1", "3.26.0.68", 512, 300, disks, True), ("old", "model1", "2.5.0.0", 512, 300, disks, True), ("odd", "x", "3.30.1.1", 512, 120, disks[:1], False)], schema)
    budgets = spark.createDataFrame([("model1", 64, 100, 50), ("unknown", 64, 100, 50)], "model string, sync_memory_mb int, min_free_memory_mb int, min_free_storage_mb int")
    found = fleet.device_health(devices, budgets).collect()
    assert {r.device_id: r.device_passed for r in found} == {"ok": True, "old": False, "odd": False}
    odd = {r.check: (r.passed, r.severity) for r in found if r.device_id == "odd"}
    assert odd["firmware"] == (True, "warning") and odd["memory"] == (True, "warning") and odd["home_storage"] == (False, "error") and odd["store"] == (False, "error")
    assert "installation_path" not in odd
    old = {r.check: (r.passed, r.severity) for r in found if r.device_id == "old"}
    assert old["installation_path"] == (False, "error") and old["firmware"] == (False, "error")
    # Without a model the memory tells which budget holds: 512 MB is the first model, 900 the second, 2 000 unknown.
    rows = [(str(mb), model, "3.26.0.68", mb, 120, disks, True) for mb, model in ((512, None), (900, " "), (2000, None))]
    limits = spark.createDataFrame([("model1", 64, 100, 50), ("model2", 64, 150, 50), ("unknown", 10, 100, 50)], "model string, sync_memory_mb int, min_free_memory_mb int, min_free_storage_mb int")
    memory = fleet.device_health(spark.createDataFrame(rows, schema), limits).filter("check = 'memory'").collect()
    assert {r.device_id: (r.passed, r.severity) for r in memory} == {"512": (True, "warning"), "900": (False, "error"), "2000": (True, "info")}
    versions = spark.createDataFrame([("2.6.0.1",), ("3.4.0.0",), ("3.3.9.9",), ("beta",)], "fw string")
    assert [tuple(r)[2:] for r in fleet.version_support(versions).collect()] == [("older", "toltec", False), ("tested", "entware", True), ("tested", "toltec", True), ("malformed", None, None)]


CHANGES = "ts timestamp, source_id string, path string"
DAY = [(0, "a.rm"), (4, "A.metadata"), (9, "skip.content"), (5, "a.tmp"), (6, "b.sync-conflict.metadata"), (12, "c/page.rm"), (23, "d.content"), (3600, "z.rm")]


def change_rows(spark):
    rows = [(at(s), "s", p) for s, p in DAY]
    return spark.createDataFrame(rows, CHANGES), spark.createDataFrame([("SKIP",)], "uuid string")


def test_debounce(spark):
    df, ignored = change_rows(spark)
    expected = [(at(0), at(22), 3), (at(23), at(33), 1), (at(3600), at(3610), 1)]
    for limit in (1000, 2):
        found = feeds.debounced_changes(df, ignored, limit=limit).orderBy("first_ts").collect()
        assert [(r.first_ts, r.due_ts, r.changes) for r in found] == expected


def test_debounce_stream(spark, tmp_path):
    df, ignored = change_rows(spark)
    df.filter("minute(ts) = 0 and hour(ts) = 0").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(CHANGES).parquet(f"{tmp_path}/in")
    feed = feeds.debounced_changes(stream, ignored, watermark="1 minute")

    def run():
        return run_to_table(feed, "append", str(tmp_path / "out")).orderBy("first_ts").collect()

    assert run() == []
    df.filter("hour(ts) = 1").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    assert [(r.first_ts, r.due_ts, r.changes) for r in run()] == [(at(0), at(22), 3), (at(23), at(33), 1)]


def test_busy_source_is_merged_before_it_is_dealt(spark, tmp_path):
    """Nine changes of ten are of one source: its task gets partial sessions of the map tasks, not the changes."""
    rows = [(at(2 * i + (40 if i % 700 > 350 else 0)), "busy" if i % 10 else f"s{i % 3}", "a.rm") for i in range(6000)]
    df = spark.createDataFrame(rows, CHANGES)
    df.repartitionByRange(6, "ts").write.parquet(f"{tmp_path}/in")
    spark.createDataFrame([(at(10**6), "busy", "z.rm"), (at(10**6 + 4000), "busy", "z.rm")], CHANGES).coalesce(1).write.parquet(f"{tmp_path}/late")
    ignored = spark.createDataFrame([("SKIP",)], "uuid string")
    received = []

    def start(folder):
        stream = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 100).parquet(folder)
        feed = feeds.debounced_changes(stream, ignored, watermark="1 minute")
        with stream_settings(spark):
            query = feed.writeStream.format("memory").queryName("due").outputMode("complete").trigger(availableNow=True).start()
        query.awaitTermination()
        plan = query._jsq.streamingQuery().lastExecution().executedPlan().toString()
        received.append(plan)
        return spark.table("due").collect()

    found = {(r.source_id, r.first_ts, r.due_ts, r.changes) for r in start(f"{tmp_path}/in")}
    want = {(r.source_id, r.first_ts, r.due_ts, r.changes) for r in feeds.debounced_changes(df, ignored).collect()}
    assert found == want and max(c for *_, c in found) > 100
    steps = [line for line in received[0].splitlines() if "MergingSessions" in line or "Exchange" in line]
    merged = [i for i, line in enumerate(steps) if "MergingSessions" in line]
    dealt = [i for i, line in enumerate(steps) if "Exchange hashpartitioning(source_id" in line]
    assert merged and dealt and min(merged) < dealt[0] < max(merged)


def test_review_state_is_merged_by_bucket(spark):
    """Events in any order and batch; a repeated batch changes nothing, old generations go, other buckets stay."""
    rng = random.Random(3)
    actions = ["accept", "accept", "dismiss", "undo", "look"]
    events = [(f"h{rng.randrange(40)}", at(i), rng.choice(actions), rng.choice([None, f"t{i}"])) for i in range(300)]
    rng.shuffle(events)
    schema = "highlight_id string, ts timestamp, action string, edited_text string"
    folder = new_folder(spark)
    handle = feeds.keep_review_state(folder, buckets=8)
    cuts = [0, 120, 121, 121, 200, 260, 300]
    for number, (a, b) in enumerate(zip(cuts, cuts[1:])):
        df = spark.createDataFrame(events[a:b], schema)
        handle(df, number)
        if number % 2:
            handle(df, number)
    df = spark.createDataFrame(events, schema)
    got = feeds.review_state(df, folder, buckets=8)
    assert sorted(map(str, got.collect())) == sorted(map(str, review.reduce_review(df).collect()))
    store = Buckets(spark, folder, review.review_parts(df).schema, 8)
    assert store.last_batch() == 5 and all(len(gs) == 1 for gs in store.manifest(5).values())
    listed = {(b, g) for n in (4, 5) for b, gs in store.manifest(n).items() for g in gs}
    place, files = path_and_files(spark, f"{folder}/data")
    there = set()
    for generation in files.listStatus(place):
        for bucket in files.listStatus(generation.getPath()):
            if "=" in bucket.getPath().getName():
                there.add((int(bucket.getPath().getName().split("=")[1]), int(generation.getPath().getName().split("=")[1])))
    assert there == listed
    place, files = path_and_files(spark, f"{folder}/manifest")
    assert len(files.listStatus(place)) == 2


def upkeep(spark):
    """(run a batch, uuids published by batch, cursors after a batch)"""
    folder = new_folder(spark)
    prev = spark.createDataFrame([("s", 5, "h"), ("t", 5, "h")], "source_id string, cursor_ms bigint, path_hash string")
    paths = prev.select("source_id", F.lit("h").alias("current_hash"))
    outcome = prev.select("source_id", F.lit(True).alias("full_scan"), F.lit(0).alias("errors"), F.lit(True).alias("clean_transfer"))

    def publish(due, number):
        due.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
        return outcome

    handle = feeds.incremental_upkeep(folder, publish, prev, paths)

    def run(number, *rows):
        schema = "source_id string, uuid string, doc_type string, last_modified bigint, readiness string"
        handle(spark.createDataFrame([(s, u, "pdf", m, r) for s, u, m, r in rows], schema), number)
        cursors = spark.read.parquet(f"{folder}/cursors/batch={number}").collect()
        published = spark.read.parquet(f"{folder}/out/batch={number}").collect()
        return sorted(r.uuid for r in published), {r.source_id: r.cursor_ms for r in cursors}

    return run


def test_upkeep_is_repeatable(spark):
    run = upkeep(spark)
    rows = [("s", "u", 7, "ready"), ("s", "v", 3, "ready"), ("t", "w", 9, "ready"), ("t", "x", 9, "pending_missing")]
    for _ in range(2):
        assert run(0, *rows) == (["u", "w"], {"s": 7, "t": 5})


def test_upkeep_loses_nothing_over_batches(spark):
    run = upkeep(spark)
    assert run(0, ("s", "late", 10, "pending_missing"), ("s", "x", 20, "ready")) == (["x"], {"s": 5, "t": 5})
    for _ in range(2):
        assert run(1, ("s", "y", 30, "ready")) == (["y"], {"s": 5, "t": 5})
    assert run(2, ("s", "late", 10, "ready")) == (["late"], {"s": 30, "t": 5})
    assert run(3, ("s", "old", 25, "ready"), ("t", "z", 8, "ready")) == (["old", "z"], {"s": 30, "t": 8})


def test_highlights_are_published_once_however_late(spark):
    folder = new_folder(spark)
    handle = feeds.publish_new_highlights(folder, buckets=4, generations=2)
    batches = [(1, "ab"), (200, "bc"), (2, "ac"), (400, "ad"), (5, ""), (6, "efgh"), (7, "aijk"), (8, "hlaa")]
    for number, (day, ids) in enumerate(batches):
        batch = spark.createDataFrame([(i, day) for i in ids], "id string, day int")
        handle(batch, number)
        handle(batch, number)
    assert sorted(r.id for r in spark.read.parquet(folder).collect()) == list("abcdefghijkl")
    known = Buckets(spark, f"{folder}/_ids", "id string", 4)
    manifest = known.manifest(known.last_batch())
    assert sorted(r.id for r in known.rows(manifest).collect()) == list("abcdefghijkl")
    assert all(len(gs) <= 2 for gs in manifest.values())


def test_a_batch_reads_the_buckets_it_touches(spark):
    folder = new_folder(spark)
    handle = feeds.publish_new_highlights(folder, buckets=16)
    handle(spark.createDataFrame([(f"i{k}",) for k in range(200)], "id string"), 0)
    known = Buckets(spark, f"{folder}/_ids", "id string", 16)
    manifest = known.manifest(0)
    assert len(manifest) == 16
    files = known.rows(manifest, {3}).inputFiles()
    assert files and all("/bucket=3/" in f for f in files)


FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["recent_documents", "whole_highlights", "text_under_rects", "merge_notes", "render_section", "reduce_review", "diff_manifests", "read_contents"])
def test_plans_stay_in_the_jvm(spark, name):
    plan = contract.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
    assert "CartesianProduct" not in plan


def test_scans_are_pruned(spark):
    plan = contract.queries()["union_boxes"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    plan = contract.queries()["diff_manifests"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.split("ReadSchema: ")[1].split(">")[0]
