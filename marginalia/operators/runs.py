"""Runs: summaries, cursors, page cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def run_summary(run_documents: DataFrame) -> DataFrame:
    """Counters of a run per source and, with ``source_id`` ``all``, in total.

    ``run_documents (source_id, doc, n_highlights, output_file, error)``.
    """
    counters = [
        F.count(F.lit(1)).alias("documents_processed"),
        F.count_if((F.col("n_highlights") > 0) & F.col("output_file").isNotNull()).alias("documents_with_highlights"),
        F.coalesce(F.sum(F.when(F.col("output_file").isNotNull(), F.col("n_highlights"))), F.lit(0)).alias("total_highlights"),
        F.count("output_file").alias("output_files"),
        F.count("error").alias("errors"),
    ]
    per_source = run_documents.groupBy("source_id").agg(*counters)
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in per_source.columns[1:]]
    return per_source.unionByName(per_source.agg(*sums).withColumn("source_id", F.lit("all")))


def run_cursors(prev: DataFrame, paths: DataFrame, force_all: bool = False) -> DataFrame:
    """The cursor each source starts from; null, so everything, when its path changed or all is asked for."""
    moved = F.col("path_hash").isNotNull() & (F.col("path_hash") != F.col("current_hash"))
    start = F.when(F.lit(force_all) | moved, F.lit(None).cast("bigint")).otherwise(F.col("cursor_ms"))
    return paths.join(prev, "source_id", "left").select("source_id", start.alias("cursor_ms"))


def next_cursor(docs: DataFrame, runs: DataFrame, prev: DataFrame, paths: DataFrame) -> DataFrame:
    """Cursor and path hash of every source after a run.

    The cursor moves to the newest change seen among ready documents only after a full scan without errors, without
    pending documents and with a clean transfer; it never goes back.

    ``docs (source_id, last_modified, readiness)``, ``runs (source_id, full_scan, errors, clean_transfer)``,
    ``prev (source_id, cursor_ms, path_hash)``, ``paths (source_id, current_hash)``.
    """
    seen = docs.groupBy("source_id").agg(
        F.max(F.when(F.col("readiness") == "ready", F.col("last_modified"))).alias("observed"),
        F.count_if(F.col("readiness") != "ready").alias("pending"),
    )
    df = paths.join(prev, "source_id", "left").join(runs, "source_id", "left").join(seen, "source_id", "left")
    clean: Column = (
        F.coalesce("full_scan", F.lit(False))
        & F.coalesce("clean_transfer", F.lit(False))
        & (F.coalesce("errors", F.lit(1)) == 0)
        & (F.coalesce("pending", F.lit(0)) == 0)
    )
    moved = F.greatest(F.coalesce("cursor_ms", F.lit(0)), F.coalesce("observed", F.lit(0)))
    return df.select(
        "source_id",
        F.when(clean, moved).otherwise(F.col("cursor_ms")).alias("cursor_ms"),
        F.when(clean, F.col("current_hash")).otherwise(F.col("path_hash")).alias("path_hash"),
        clean.alias("advanced"),
    )


def page_cache_plan(inputs: DataFrame, cache: DataFrame, settings: str, ocr_on: bool = False) -> DataFrame:
    """Per page what the renderer has to do: ``reuse``, ``ocr_only`` or ``recompute``.

    A page is reused while file name, change time, template and settings are the same and its image is there.
    Recognised text is kept but not reported while recognition is off.
    """
    key = ["doc", "page_id"]
    kept = cache.filter(F.col("settings") == settings).select(
        *key, F.col("filename").alias("c_filename"), F.col("rm_mtime").alias("c_mtime"), F.col("template").alias("c_template"), "ocr_text"
    )
    fresh = (
        (F.col("filename") == F.col("c_filename"))
        & (F.col("rm_mtime") == F.col("c_mtime"))
        & F.col("template").eqNullSafe(F.col("c_template"))
        & F.col("output_exists")
    )
    unread = F.lit(ocr_on) & F.col("ocr_text").isNull()
    action = F.when(~F.coalesce(fresh, F.lit(False)), "recompute").when(unread, "ocr_only").otherwise("reuse")
    reported = F.when((F.col("action") == "reuse") & F.lit(ocr_on), F.col("ocr_text")).otherwise(F.lit(""))
    planned = inputs.join(kept, key, "left").withColumn("action", action)
    return planned.select(*key, "filename", "action", reported.alias("reported_ocr"))
