"""Stores of files, notes and published results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.ids import extension, is_uuid

UUID_HEAD = "(?i)^([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})"

# What a store holds beside documents.
SKIPPED_FOLDERS = [".textconversion", ".highlights", ".stfolder"]
SKIPPED_FILES = [".stignore", ".local"]
SKIPPED_ENDINGS = [".pagedata"]
CONFLICT = "sync-conflict"

# The header of a note: the lines between a first line and a later line of three dashes.
FRONT_MATTER = "(?s)\\A\ufeff?---[ \\t]*\\r?\\n(.*?)(?<=\\n)---[ \\t]*(?:\\r?\\n|\\z)"

# First bytes of a stroke file.
STROKE_MAGIC = "reMarkable .lines file, version="


def manifest_rows(listing: DataFrame, root: str, source_id: str, side: str = "remote") -> DataFrame:
    """A manifest of ``listing (path, size, mtime_s)``, the files below ``root``, from wherever it was taken.

    Paths become relative to the store.  The owner is the identifier that the first part of the path starts with, so a
    page belongs to its document; each first part with files in it gives a row of its own as a folder, as old as its
    newest file.
    """
    base = root.rstrip("/") + "/"
    below = listing.filter(F.col("path").startswith(base))
    files = below.select(F.expr(f"substring(path, {len(base) + 1})").alias("path"), "size", "mtime_s")
    top, nested = F.split("path", "/")[0], F.instr("path", "/") > 0
    inside = files.filter(nested).groupBy(top.alias("path")).agg(F.max("mtime_s").alias("mtime_s"))
    folders = inside.select("path", F.lit(0).cast("bigint").alias("size"), "mtime_s", F.lit(True).alias("is_dir"))
    both = files.withColumn("is_dir", F.lit(False)).unionByName(folders)
    name = F.element_at(F.split("path", "/"), -1)
    return both.select(
        F.lit(source_id).alias("source_id"),
        F.lit(side).alias("side"),
        "path",
        name.alias("name"),
        F.lower(F.regexp_extract(top, UUID_HEAD, 1)).alias("uuid"),
        F.when(F.col("is_dir"), F.lit("")).otherwise(extension(name)).alias("ext"),
        F.col("size").cast("bigint").alias("size"),
        F.col("mtime_s").cast("bigint").alias("mtime_s"),
        "is_dir",
    )


def scan_manifest(spark: SparkSession, path: str, source_id: str, side: str = "remote") -> DataFrame:
    """List a store without reading a byte of its files.

    Spark holds the status of every listed file in the driver; for a store of very many files take the listing from
    an inventory table and hand it to ``manifest_rows``.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    listing = files.select("path", F.col("length").alias("size"), F.unix_seconds("modificationTime").alias("mtime_s"))
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    root = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()
    return manifest_rows(listing, root, source_id, side)


def classify_entries(manifest: DataFrame, include_epub: bool = True) -> DataFrame:
    """``reason`` for every listed name: ``keep``, or why it is left out."""
    name, ext = F.col("name"), extension(F.col("name"))
    wanted = [".metadata", ".content", ".pdf"] + ([".epub"] if include_epub else [])
    folder = (
        F.when(name.isin(SKIPPED_FOLDERS), "skipped folder").when(is_uuid(name), "keep").otherwise("other folder")
    )
    file = (
        F.when(name.isin(SKIPPED_FILES), "skipped file")
        .when(name.contains(CONFLICT), "conflict copy")
        .when(ext.isin(SKIPPED_ENDINGS), "skipped ending")
        .when(ext.isin(wanted), "keep")
        .otherwise("other file")
    )
    return manifest.withColumn("reason", F.when(F.col("is_dir"), folder).otherwise(file))


def relevant_entries(manifest: DataFrame, include_epub: bool = True) -> DataFrame:
    return classify_entries(manifest, include_epub).filter(F.col("reason") == "keep").drop("reason")


def sniff_stroke_format(files: DataFrame, magic: str = STROKE_MAGIC) -> DataFrame:
    """Format from the first bytes of ``content``: strict prefix, tolerant search, and the decoder it needs."""
    head = F.substring("content", 1, 64).cast("string")
    tolerant_head = F.substring("content", 1, 48).cast("string")
    strict = tolerant = None
    for v in ("6", "5", "3"):
        by_prefix, by_search = head.startswith(magic + v), tolerant_head.contains("version=" + v)
        strict = (F if strict is None else strict).when(by_prefix, f"v{v}")
        tolerant = (F if tolerant is None else tolerant).when(by_search, f"v{v}")
    df = files.withColumn("format", strict.otherwise("unknown")).withColumn("seen_format", tolerant.otherwise("unknown"))
    needs = F.when(F.col("format") == "v6", "scene").when(F.col("format").isin("v5", "v3"), "legacy")
    return df.withColumn("needs", needs).drop("content")


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """Markdown notes as ``(path, body)``."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))


def read_note_headers(notes: DataFrame, uuid_key: str = "remarkable_uuid") -> DataFrame:
    """(uuid, path, base_name, highlight_count) of every note ``(path, body)`` whose header names a document."""
    header = F.regexp_extract("body", FRONT_MATTER, 1)
    owner = F.regexp_extract(header, f"(?m)^{uuid_key}:\\s*([0-9a-fA-F-]{{36}})\\s*$", 1)
    count = F.regexp_extract(header, "(?m)^highlight_count:\\s*(\\d+)$", 1)
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), "\\.md\\z", "")
    headers = notes.filter(F.col("path").endswith(".md")).select(
        F.lower(owner).alias("uuid"),
        "path",
        name.alias("base_name"),
        F.coalesce(F.nullif(count, F.lit("")).cast("bigint"), F.lit(0)).alias("highlight_count"),
    )
    return headers.filter(F.col("uuid") != "")


def read_note_registry(notes: DataFrame, uuid_key: str = "remarkable_uuid") -> DataFrame:
    """(uuid, base_name, highlight_count), one row per document; of several notes the first name wins."""
    first = F.min(F.struct("base_name", "highlight_count")).alias("first")
    return read_note_headers(notes, uuid_key).groupBy("uuid").agg(first).select("uuid", "first.*")


POINTER = "run_id string, run_seq bigint, version string"


def _pointers(spark: SparkSession, folder: str) -> DataFrame:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/published")
    there = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
    return spark.read.schema(POINTER).parquet(f"{folder}/published") if there else spark.createDataFrame([], POINTER)


def write_notes(notes: DataFrame, folder: str, run_id: str) -> None:
    """Publish ``(path, body)`` rows all at once: a complete folder of their own first, then the pointer to it.

    A repeated ``run_id`` is a new version; what was published before stays as it is until the pointer moves.
    """
    spark, version = notes.sparkSession, f"{run_id}-{uuid.uuid4().hex}"
    notes.write.parquet(f"{folder}/runs/{version}")
    last = _pointers(spark, folder).agg(F.max("run_seq")).first()[0]
    pointer = spark.createDataFrame([(run_id, (last or 0) + 1, version)], POINTER)
    pointer.coalesce(1).write.mode("append").parquet(f"{folder}/published")


def published_notes(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the run published last, by the sequence of publications."""
    version = _pointers(spark, folder).orderBy(F.desc("run_seq"), F.desc("version")).first()["version"]
    return spark.read.parquet(f"{folder}/runs/{version}")
