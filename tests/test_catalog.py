"""Sidecars, catalogue, folder tree."""

import random

import pytest
from pyspark.sql import functions as F

from marginalia.operators import catalog, tree
from marginalia.sources import json as sidecars
from marginalia.sources import store

JSON = "source_id string, uuid string, value string"
ENTRY = "source_id string, uuid string, name string, parent string, entry_type string, deleted boolean"


def entries(spark, *rows):
    return spark.createDataFrame([("s", u, n, p, "CollectionType" if f else "DocumentType", d) for u, n, p, f, d in rows], ENTRY)


def test_read_entries(spark):
    rows = [
        ("s", "full", '{"visibleName":"Test Paper","parent":"folder-uuid-123","lastModified":"1700000000000"}'),
        ("s", "defaults", "{}"),
        ("s", "malformed", "not valid json{{{"),
        ("s", "types", '{"visibleName":5,"deleted":"yes","type":[],"lastModified":"12"}'),
        ("s", "cut", '{"visibleName":"x"'),
        ("s", "array", "[1]"),
        ("s", "empty", ""),
        ("s", "soon", '{"lastModified":"soon"}'),
    ]
    df = spark.createDataFrame(rows, JSON)
    found = {r.uuid: r for r in sidecars.read_entries(df).collect()}
    assert set(found) == {"full", "defaults", "types"}
    assert found["full"].last_modified == 1700000000000 and not found["full"].deleted
    assert (found["defaults"].name, found["defaults"].parent, found["defaults"].entry_type) == ("Untitled", "", "DocumentType")
    assert (found["types"].name, found["types"].deleted, found["types"].entry_type) == ("Untitled", False, "DocumentType")
    assert tuple(sidecars.count_malformed(df).first()) == ("s", 8, 5)


def test_read_contents(spark):
    rows = [
        ("s", "legacy", '{"pages":["page-1","page-2","page-3"],"pageCount":3}'),
        ("s", "newer", '{"cPages":{"pages":[{"id":"v6-page-1"},{"id":"v6-page-2"}]}}'),
        (
            "s",
            "deleted",
            '{"cPages":{"pages":[{"id":"p1","template":{"value":"P Lines medium"}},{"id":"p2","deleted":true},'
            '{"id":"p3","template":{"value":"Blank"},"redir":{"value":7}},{"uuid":"p4"}]},"tags":["a",{"name":"b"}]}',
        ),
        ("s", "broken", '{"cPages":{"pages":['),
    ]
    contents = sidecars.read_contents(spark.createDataFrame(rows, JSON))
    found = {r.uuid: r for r in contents.collect()}
    assert [p.page_id for p in found["legacy"].pages] == ["page-1", "page-2", "page-3"]
    assert [p.page_id for p in found["newer"].pages] == ["v6-page-1", "v6-page-2"]
    assert [(p.page_id, p.template, p.pdf_idx) for p in found["deleted"].pages] == [("p1", "P Lines medium", None), ("p3", "Blank", 7), ("p4", "", None)]
    assert (found["deleted"].page_count, found["deleted"].listed_pages, found["deleted"].tags) == (3, 4, ["a", "b"])
    assert found["broken"].is_corrupt and not found["legacy"].is_corrupt
    pages = sidecars.number_pages(contents).filter("uuid = 'deleted'").orderBy("page").collect()
    assert [(p.page, p.page_id) for p in pages] == [(1, "p1"), (2, "p3"), (3, "p4")]


def test_paths(spark):
    df = entries(
        spark,
        ("folder-1", "Research Papers", "", True, False),
        ("folder-2", "Machine Learning", "folder-1", True, False),
        ("doc-1", "Doc", "folder-2", False, False),
        ("orphan", "Lost", "nonexistent-folder", False, False),
        ("a", "A", "b", True, False),
        ("b", "B", "a", True, False),
        ("in-cycle", "C", "a", False, False),
    )
    paths = {r.uuid: r.folder_path for r in tree.resolve_folder_paths(df).collect()}
    assert paths["doc-1"] == "Research Papers/Machine Learning"
    assert paths["folder-2"] == "Research Papers" and paths["folder-1"] == ""
    assert paths["orphan"] == "" and paths["in-cycle"] == ""


def test_deep_path_is_whole(spark):
    rows = [(f"f{i}", f"n{i}", f"f{i - 1}" if i else "", True, False) for i in range(70)]
    df = entries(spark, *rows, ("doc", "d", "f69", False, False))
    path = tree.resolve_folder_paths(df).filter("uuid = 'doc'").first().folder_path
    assert path == "/".join(f"n{i}" for i in range(70))


@pytest.mark.parametrize(
    "parents, expected",
    [
        ({"doc-a": "trash", "doc-b": ""}, {"doc-a"}),
        ({"folder": "trash", "doc": "folder", "other": ""}, {"folder", "doc"}),
        ({"a": "b", "b": "a"}, set()),
        ({"a": "b", "b": "a", "f": "trash", "d": "f", "e": "d"}, {"f", "d", "e"}),
    ],
)
def test_trash(spark, parents, expected):
    df = entries(spark, *[(u, u, p, False, False) for u, p in parents.items()])
    assert {r.uuid for r in tree.trashed_ids(df).collect()} == expected


def test_tree_order_and_rollup(spark):
    df = entries(
        spark,
        ("f", "Folder", "", True, False),
        ("g", "Inner", "f", True, False),
        ("h", "Empty", "f", True, False),
        ("d1", "Zebra", "", False, False),
        ("d2", "Alpha", "g", False, False),
        ("d3", "Beta", "f", False, False),
    )
    assert [r.uuid for r in tree.order_tree(df).collect()] == ["d1", "f", "d3", "h", "g", "d2"]
    rollup = {r.uuid: r for r in tree.folder_rollup(df).collect()}
    assert (rollup["f"].documents, rollup["f"].subfolders, rollup["f"].all_documents, rollup["f"].all_subfolders) == (1, 2, 2, 2)
    assert rollup["h"].is_empty and not rollup["g"].is_empty


def brute_tree(rows):
    """uuid -> (path among all, path among live ones or None, counts below) by walking up from every entry."""
    by = {u: (u, n, p, f, d) for u, n, p, f, d in rows}

    def above(u, fits):
        names, seen, p = [], set(), by[u][2]
        while p in by and fits(by[p]):
            if p in seen:
                return None
            seen.add(p)
            names.insert(0, (p, by[p][1]))
            p = by[p][2]
        return names

    def trashed(u):
        seen, p = set(), by[u][2]
        while p in by and p not in seen:
            seen.add(p)
            p = by[p][2]
        return p == "trash"

    every = {u: "/".join(n for _, n in above(u, lambda r: r[3]) or []) for u in by}
    live = {u: "/".join(n for _, n in above(u, lambda r: r[3] and not r[4]) or []) for u in by if not by[u][4] and not trashed(u)}
    sums = {u: [0, 0] for u in by if by[u][3]}
    for u in by:
        for p, _ in above(u, lambda r: r[3]) or []:
            # An entry counts below every folder from whose chain nothing hangs on a cycle.
            if above(p, lambda r: r[3]) is not None:
                sums[p][by[u][3]] += 1
    return every, live, sums


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_trees_with_cycles_trash_and_deep_chains(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(150):
        parent = rng.choice([f"e{rng.randrange(150)}", f"e{max(0, i - 1)}", f"e{rng.randrange(max(1, i))}", "", "trash", "lost"])
        rows.append((f"e{i}", f"n{i}", parent if parent != f"e{i}" else "", rng.random() < 0.75, rng.random() < 0.1))
    every, live, sums = brute_tree(rows)
    df = entries(spark, *rows)
    assert {r.uuid: r.folder_path for r in tree.resolve_folder_paths(df).collect()} == every
    assert {r.uuid: r.folder_path for r in tree.resolve_folder_paths(df, live=True).collect()} == live
    assert {r.uuid for r in tree.live_entries(df).collect()} == set(live)
    assert {r.uuid: [r.all_documents, r.all_subfolders] for r in tree.folder_rollup(df).collect()} == sums


def test_deep_chain_writes_open_folders_only(spark, monkeypatch):
    """3 000 folders one below the other: every round writes the folders that are still open, a row each."""
    n, written = 3000, []
    rows = [(f"f{i}", "n", f"f{i - 1}" if i else "", True, False) for i in range(n)] + [("d", "doc", f"f{n - 1}", False, False)]
    df = entries(spark, *rows)
    kept = tree._written
    monkeypatch.setattr(tree, "_written", lambda rows, still: written.append(kept(rows, still)) or written[-1])
    rollup = {r.uuid: (r.all_documents, r.all_subfolders) for r in tree.folder_rollup(df).collect()}
    assert rollup == {f"f{i}": (1, n - 1 - i) for i in range(n)}
    assert [w[0].count() for w in written] == [n - 1] + [max(0, n - 2**k) for k in range(1, 13)]
    written.clear()
    assert tree.trashed_ids(df).isEmpty()
    assert [w[0].count() for w in written] == [n] + [n - 2**k for k in range(0, 12)]


def test_empty_tree(spark):
    df = spark.createDataFrame([], entries(spark, ("a", "a", "", True, False)).schema)
    assert tree.folder_rollup(df).collect() == [] and tree.resolve_folder_paths(df, live=True).collect() == [] and tree.trashed_ids(df).collect() == []


def test_types_and_readiness(spark):
    contents = spark.createDataFrame([("s", "1", "pdf", False), ("s", "2", "epub", False), ("s", "3", "", True), ("s", "4", "PDF", False)], "source_id string, uuid string, file_type string, is_corrupt boolean")
    assert {r.uuid: r.doc_type for r in catalog.with_document_type(contents).collect()} == {"1": "pdf", "2": "epub", "3": "notebook"}
    assert {r.uuid: r.doc_type for r in catalog.with_document_type(contents, "notebook").collect()}["4"] == "pdf"
    docs = entries(spark, *[(str(i), "n", "", False, False) for i in range(1, 6)])
    ready = catalog.classify_readiness(docs, contents)
    assert {r.uuid: r.readiness for r in ready.collect()} == {"1": "ready", "2": "ready", "3": "pending_corrupt", "4": "ready", "5": "pending_missing"}
    assert catalog.pending_count(ready).first().pending_count == 2


def test_library(spark):
    schema = "uuid string, name string, doc_type string, last_modified bigint, highlight_count bigint, sync_status string, folder_path string, source_id string"
    docs = [("1", "Zebra", "pdf", 3, 5, "synced", "Work", "a"), ("2", "alpha", "epub", 1, 3, "pending", "", "a"), ("3", "Middle", "pdf", 2, 2, "error", "", "b")]
    df = spark.createDataFrame(docs, schema)
    assert [r.name for r in catalog.sort_library(df).collect()] == ["alpha", "Middle", "Zebra"]
    assert [r.uuid for r in catalog.sort_library(df, "last_modified", "desc").collect()] == ["1", "3", "2"]
    assert tuple(catalog.library_summary(df).first()) == (3, 1, 1, 10)
    assert tuple(catalog.library_summary(df.limit(0)).first()) == (0, 0, 0, 0)
    assert {r.uuid for r in catalog.search_library(df, "WORK").collect()} == {"1"}
    assert catalog.search_library(df, "  ").count() == 3
    both = catalog.union_sources([df], df.limit(1))
    assert both.filter("sync_status = 'archived'").count() == 1
    assert catalog.filter_source(both, "a").count() == 2 and catalog.filter_source(both).count() == 4


def test_since(spark):
    df = spark.createDataFrame([("a", "pdf", 5), ("a", "pdf", 6), ("a", "notebook", 1), ("b", "pdf", 1)], "source_id string, doc_type string, last_modified bigint")
    cursors = spark.createDataFrame([("a", 5)], "source_id string, cursor_ms bigint")
    assert catalog.since(df, cursors).count() == 3
    assert catalog.since(df, cursors, notebooks_bypass=False).count() == 2


def test_manifest_scan_reads_no_content(spark, tmp_path):
    uuid = "0f8fad5b-d9cb-469f-a165-70867728950e"
    (tmp_path / f"{uuid}.pdf").write_bytes(b"12345")
    (tmp_path / uuid).mkdir()
    (tmp_path / uuid / "p1.rm").write_bytes(b"reMarkable .lines file, version=6          ")
    manifest = store.scan_manifest(spark, str(tmp_path), "s")
    assert {(r.path, r.ext, r.size) for r in manifest.collect()} == {(f"{uuid}.pdf", ".pdf", 5), (f"{uuid}/p1.rm", ".rm", 43), (uuid, "", 0)}
    assert {r.uuid for r in manifest.collect()} == {uuid}
    plan = manifest._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]
    sniffed = store.sniff_stroke_format(spark.read.format("binaryFile").load(f"{tmp_path}/{uuid}").select("path", "content"))
    assert tuple(sniffed.select("format", "seen_format", "needs").first()) == ("v6", "v6", "scene")


def test_classify(spark):
    uuid = "0f8fad5b-d9cb-469f-a165-70867728950e"
    names = [(".textconversion", True), (uuid, True), (f"{uuid}.cache", True), (".stignore", False), ("x.sync-conflict-1.metadata", False), ("a.pagedata", False), ("a.PDF", False), ("a.epub", False), ("a.txt", False)]
    df = spark.createDataFrame(names, "name string, is_dir boolean")
    reasons = {r.name: r.reason for r in store.classify_entries(df).collect()}
    assert [reasons[n] for n, _ in names] == ["skipped folder", "keep", "other folder", "skipped file", "conflict copy", "skipped ending", "keep", "keep", "other file"]
    assert store.relevant_entries(df, include_epub=False).filter("name = 'a.epub'").count() == 0


def test_emitted_results_are_accepted(spark):
    docs = spark.createDataFrame([(1, "u", "v", "pdf", 5, 2), (2, "w", "x", "notebook", 5, 0)], "doc int, uuid string, visible_name string, doc_type string, last_modified bigint, page_count int")
    marks = spark.createDataFrame([(1, 0, "t", 1, None, (1.0, 2.0, 3.0, 4.0))], "doc int, seq bigint, text string, page int, color string, bounds struct<x:double,y:double,width:double,height:double>")
    records = sidecars.emit_results_json(docs, marks)
    payload = records.select(F.col("doc").alias("payload_id"), F.concat(F.lit('{"success":true,"errors":[],"documents":['), "value", F.lit("]}")).alias("value"))
    assert [(r.reason, r.accepted) for r in sidecars.quarantine_invalid(payload).collect()] == [(None, True)] * 2


def test_quarantine(spark):
    good = '{"uuid":"u","visible_name":"v","folder_path":"","doc_type":"pdf","last_modified":1,"page_count":2,"has_pdf":true,"highlights":[%s],"error":null}'
    mark = '{"text":"t","page_number":1,"color":null,"bounds":%s,"created_at":null}'
    payloads = [
        (1, '{"success":true,"documents":[' + good % (mark % "null") + "]}"),
        (2, '{"success":true,"documents":[' + good % (mark % '{"x":1,"y":2,"width":3}') + "," + good % "" + "]}"),
        (3, '{"documents":[]}'),
    ]
    df = spark.createDataFrame(payloads, "payload_id int, value string")
    found = {(r.payload_id, r.doc_idx): (r.reason, r.accepted) for r in sidecars.quarantine_invalid(df).collect()}
    assert found == {(1, 0): (None, True), (2, 0): ("highlight", False), (2, 1): (None, False), (3, None): ("structure", False)}
    with pytest.raises(Exception, match="invalid result payload"):
        sidecars.quarantine_invalid(df, strict=True).collect()


def test_first_annotated(spark):
    """With a limit the plan keeps the first rows of each task; ranks are those of the whole list."""
    schema = "uuid string, last_modified bigint, file_type string, entry_type string, deleted boolean"
    docs = spark.createDataFrame([(f"u{i:03}", i % 40, "pdf" if i % 2 else None, "DocumentType", False) for i in range(200)], schema)
    notes = docs.select("uuid", F.lit(1).alias("highlight_count"))
    whole = [tuple(r) for r in catalog.recent_annotated(docs, notes).select("uuid", "rank").collect()]
    first = catalog.recent_annotated(docs, notes, 7).select("uuid", "rank")
    assert [tuple(r) for r in first.collect()] == whole[:7]
    assert [r[1] for r in whole] == list(range(1, 201))
    assert "TakeOrderedAndProject" in first._jdf.queryExecution().executedPlan().toString()
