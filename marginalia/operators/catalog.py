"""The document catalogue: types, selection, readiness, search, sorting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.operators.ordered import with_rank
from marginalia.operators.tree import KEY, resolve_folder_paths


def with_document_type(df: DataFrame, unknown: str = "drop") -> DataFrame:
    """Adds ``doc_type``.  ``unknown='drop'`` leaves other file types out, ``'notebook'`` counts them as notebooks."""
    if unknown == "notebook":
        kind = F.lower("file_type")
        return df.withColumn("doc_type", F.when(kind.isin("pdf", "epub"), kind).otherwise(F.lit("notebook")))
    kind = F.coalesce("file_type", F.lit(""))
    typed = df.withColumn("doc_type", F.when(kind.isin("pdf", "epub"), kind).when(kind.isin("", "notebook"), F.lit("notebook")))
    return typed.filter(F.col("doc_type").isNotNull())


def select_documents(df: DataFrame, include_pdf: bool = True, include_notebook: bool = True, include_epub: bool = True) -> DataFrame:
    wanted = [t for t, on in (("pdf", include_pdf), ("notebook", include_notebook), ("epub", include_epub)) if on]
    return df.filter(F.col("doc_type").isin(wanted))


def since(df: DataFrame, cursors: DataFrame, notebooks_bypass: bool = True) -> DataFrame:
    """Documents changed after their source's cursor ``(source_id, cursor_ms)``; no cursor means all.

    Notebooks always pass unless ``notebooks_bypass`` is off.
    """
    fresh = F.col("cursor_ms").isNull() | (F.col("last_modified") > F.col("cursor_ms"))
    if notebooks_bypass:
        fresh = fresh | (F.col("doc_type") == "notebook")
    return df.join(cursors.select("source_id", "cursor_ms"), "source_id", "left").filter(fresh).drop("cursor_ms")


def search_library(df: DataFrame, query: str) -> DataFrame:
    """Name or folder path contains the query, whatever the case; a blank query finds everything."""
    if not query.strip():
        return df
    needle = F.lower(F.lit(query))
    return df.filter(F.lower("name").contains(needle) | F.lower("folder_path").contains(needle))


def filter_source(df: DataFrame, source_id: str = "all") -> DataFrame:
    """One source, without archived rows; or everything."""
    if source_id == "all":
        return df
    return df.filter((F.col("source_id") == source_id) & (F.col("sync_status") != "archived"))


def sort_library(df: DataFrame, field: str = "name", direction: str = "asc", collation: str = "UNICODE") -> DataFrame:
    """Sorted by name, last_modified, doc_type or highlight_count, with the place of each row as ``rank``; texts in locale
    order, ties by uuid."""
    key = F.collate(F.col(field), collation) if field in ("name", "doc_type") else F.col(field)
    return with_rank(df, [key.asc() if direction == "asc" else key.desc(), F.col("uuid").asc()]).orderBy("rank")


def classify_readiness(entries: DataFrame, contents: DataFrame) -> DataFrame:
    """Documents with ``readiness``: ready, pending_missing (no content sidecar) or pending_corrupt."""
    documents = entries.filter(F.col("entry_type") != "CollectionType")
    status = (
        F.when(F.col("is_corrupt").isNull(), "pending_missing").when(F.col("is_corrupt"), "pending_corrupt").otherwise("ready")
    )
    return documents.join(contents, KEY, "left").withColumn("readiness", status)


def pending_count(classified: DataFrame) -> DataFrame:
    return classified.groupBy("source_id").agg(F.count_if(F.col("readiness") != "ready").alias("pending_count"))


def with_source_presence(docs: DataFrame, manifest: DataFrame) -> DataFrame:
    """``has_pdf``: a PDF lies in the store; ``has_source_file``: the file its own type needs does."""
    present = (
        manifest.filter(F.col("ext").isin(".pdf", ".epub"))
        .groupBy(*KEY)
        .agg(F.bool_or(F.col("ext") == ".pdf").alias("pdf"), F.bool_or(F.col("ext") == ".epub").alias("epub"))
    )
    own = ((F.col("doc_type") == "pdf") & F.col("has_pdf")) | ((F.col("doc_type") == "epub") & F.coalesce("epub", F.lit(False)))
    return (
        docs.join(present, KEY, "left")
        .withColumn("has_pdf", F.coalesce("pdf", F.lit(False)))
        .withColumn("has_source_file", own)
        .drop("pdf", "epub")
    )


def select_requested(docs: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents asked for, requests that match no document)."""
    return docs.join(wanted, "uuid", "left_semi"), wanted.join(docs, "uuid", "left_anti")


def missing_errors(missing: DataFrame) -> DataFrame:
    return missing.select("uuid", F.concat(F.lit("Document not found: "), F.col("uuid")).alias("error"))


def discover_documents(entries: DataFrame, contents: DataFrame, manifest: DataFrame) -> DataFrame:
    """Live, ready documents with type, folder path and source presence."""
    placed = resolve_folder_paths(entries, live=True)
    ready = classify_readiness(placed, contents).filter(F.col("readiness") == "ready")
    return with_source_presence(with_document_type(ready), manifest)


def union_sources(active: list[DataFrame], archived: DataFrame | None = None) -> DataFrame:
    """All sources as one library; archive rows carry the status ``archived``."""
    parts = list(active)
    if archived is not None:
        parts.append(archived.withColumn("sync_status", F.lit("archived")))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def recent_annotated(docs: DataFrame, registry: DataFrame, limit: int | None = None) -> DataFrame:
    """PDF documents whose note holds a highlight, newest first, with their place as ``rank``; the first ``limit`` of them.

    Without content a document counts as PDF.  With a limit each task keeps its own first rows.
    """
    is_pdf = F.lower(F.coalesce(F.nullif(F.col("file_type"), F.lit("")), F.lit("pdf"))) == "pdf"
    documents = docs.filter(~F.col("deleted") & (F.col("entry_type") != "CollectionType") & is_pdf)
    noted = documents.join(registry.filter(F.col("highlight_count") > 0), "uuid")
    order = [F.desc("last_modified"), F.asc("uuid")]
    if limit is None:
        return with_rank(noted, order).orderBy("rank")
    first = noted.orderBy(*order).limit(limit)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint")).orderBy("rank")


def library_summary(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total_documents"),
        F.count_if(F.col("sync_status") == "pending").alias("pending_documents"),
        F.count_if(F.col("sync_status") == "error").alias("error_documents"),
        F.coalesce(F.sum("highlight_count"), F.lit(0)).alias("total_highlights"),
    )


def merge_tags(defaults, own):
    """Default tags, then the document's, each once and in order."""
    return F.array_distinct(F.concat(F.coalesce(defaults, F.array().cast("array<string>")), F.coalesce(own, F.array().cast("array<string>"))))
