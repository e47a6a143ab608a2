"""JSON sidecars to typed rows.  Fields are read as VARIANT so that one wrong type never costs the record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTRY_FIELDS = ("visibleName", "parent", "type", "lastModified", "lastOpened", "createdTime", "deleted", "pinned", "version")
CONTENT_FIELDS = ("fileType", "pageCount", "pages", "cPages", "redirectionPageMap", "tags", "pageTags")


def _parsed(df: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Adds ``j`` (struct of VARIANT fields) and ``is_corrupt``."""
    schema = ", ".join(f"{f} VARIANT" for f in fields) + ", _corrupt STRING"
    parsed = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    df = df.withColumn("j", parsed)
    is_object = F.ltrim(F.col("value")).startswith("{")
    return df.withColumn("is_corrupt", F.col("j").isNull() | F.col("j._corrupt").isNotNull() | ~F.coalesce(is_object, F.lit(False)))


def kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def text(v: Column) -> Column:
    """The value when it is a JSON string, else null."""
    return F.when(kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def number(v: Column, to: str = "double") -> Column:
    """The value when it is a JSON number, else null."""
    return F.when(is_number(v), F.try_variant_get(v, "$", to))


def is_number(v: Column) -> Column:
    return kind(v).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")


def flag(v: Column) -> Column:
    return F.when(kind(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))


def items(v: Column) -> Column:
    """Elements when the value is a JSON array, else null."""
    return F.when(kind(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>"))


def epoch(v: Column) -> Column:
    """Epoch carried as a digit string (or a number); absent is 0, text without digits is null."""
    digits = F.regexp_extract(text(v), "^\\s*([+-]?\\d+)", 1)
    written = F.nullif(digits, F.lit("")).try_cast("bigint")
    return F.when(text(v).isNotNull(), written).otherwise(F.coalesce(number(v, "bigint"), F.lit(0)))


def with_entry_fields(json_df: DataFrame) -> DataFrame:
    """Every sidecar row with the entry columns and ``is_malformed``."""
    df = _parsed(json_df, ENTRY_FIELDS)
    modified = epoch(F.col("j.lastModified"))
    return df.select(
        "source_id",
        "uuid",
        F.coalesce(text(F.col("j.visibleName")), F.lit("Untitled")).alias("name"),
        F.coalesce(text(F.col("j.parent")), F.lit("")).alias("parent"),
        F.coalesce(text(F.col("j.type")), F.lit("DocumentType")).alias("entry_type"),
        modified.alias("last_modified"),
        F.coalesce(epoch(F.col("j.lastOpened")), F.lit(0)).alias("last_opened"),
        F.coalesce(epoch(F.col("j.createdTime")), F.lit(0)).alias("created"),
        F.coalesce(flag(F.col("j.deleted")), F.lit(False)).alias("deleted"),
        F.coalesce(flag(F.col("j.pinned")), F.lit(False)).alias("pinned"),
        F.coalesce(number(F.col("j.version"), "int"), F.lit(0)).alias("version"),
        (F.col("is_corrupt") | modified.isNull()).alias("is_malformed"),
    )


def read_entries(json_df: DataFrame) -> DataFrame:
    """Metadata sidecars ``(source_id, uuid, value)`` to entries; malformed rows are left out."""
    return with_entry_fields(json_df).filter(~F.col("is_malformed")).drop("is_malformed")


def count_malformed(json_df: DataFrame) -> DataFrame:
    """Sidecars seen and left out, per source."""
    return (
        with_entry_fields(json_df)
        .groupBy("source_id")
        .agg(F.count(F.lit(1)).alias("sidecars"), F.count_if("is_malformed").alias("malformed"))
    )


def _page_id(page: Column) -> Column:
    return F.coalesce(text(field(page, "id")), text(field(page, "uuid")))


def read_contents(json_df: DataFrame) -> DataFrame:
    """Content sidecars to one row per document with its live pages in order.

    ``cPages.pages`` without deleted pages when present, else ``pages``.  ``page_count`` falls back to the live
    pages, ``listed_pages`` also counts deleted ones.
    """
    df = _parsed(json_df, CONTENT_FIELDS)
    newer = items(field(F.col("j.cPages"), "pages"))
    older = items(F.col("j.pages"))
    remap = items(F.col("j.redirectionPageMap"))
    live = F.filter(newer, lambda p: kind(p).startswith("OBJECT") & ~F.coalesce(flag(field(p, "deleted")), F.lit(False)))

    def template(page: Column) -> Column:
        t = field(page, "template")
        return F.coalesce(text(t), text(field(t, "value")), F.lit(""))

    from_newer = F.transform(
        live,
        lambda p: F.struct(
            _page_id(p).alias("page_id"),
            template(p).alias("template"),
            number(field(field(p, "redir"), "value"), "int").alias("pdf_idx"),
        ),
    )
    from_older = F.transform(
        F.filter(older, lambda p: kind(p) == "STRING"),
        lambda p, i: F.struct(
            text(p).alias("page_id"), F.lit("").alias("template"), number(F.get(remap, i), "int").alias("pdf_idx")
        ),
    )
    nothing = F.array().cast("array<struct<page_id:string,template:string,pdf_idx:int>>")
    df = df.withColumn("pages", F.coalesce(from_newer, from_older, nothing))
    pages = F.filter("pages", lambda p: F.coalesce(p["page_id"], F.lit("")) != "")
    declared = number(F.col("j.pageCount"), "int")
    listed = F.coalesce(F.size(newer), F.size(older), F.lit(0))
    tag_names = F.transform(items(F.col("j.tags")), lambda t: F.coalesce(text(t), text(field(t, "name")), F.lit("")))
    page_tags = F.transform(
        items(F.col("j.pageTags")),
        lambda t: F.struct(text(field(t, "pageId")).alias("page_id"), text(field(t, "name")).alias("tag")),
    )
    return df.select(
        "source_id",
        "uuid",
        F.coalesce(text(F.col("j.fileType")), F.lit("")).alias("file_type"),
        F.coalesce(declared, F.size(pages)).alias("page_count"),
        F.when(F.coalesce(declared, F.lit(0)) != 0, declared).otherwise(listed).alias("listed_pages"),
        "pages",
        F.coalesce(F.filter(tag_names, lambda t: t != ""), F.array().cast("array<string>")).alias("tags"),
        F.coalesce(
            F.filter(page_tags, lambda t: (t["page_id"] != "") & (t["tag"] != "")),
            F.array().cast("array<struct<page_id:string,tag:string>>"),
        ).alias("page_tags"),
        "is_corrupt",
    )


def number_pages(contents: DataFrame) -> DataFrame:
    """One row per live page: 0-based position, 1-based number, id, template, source page."""
    return contents.select("source_id", "uuid", F.posexplode("pages").alias("page_idx", "p")).select(
        "source_id",
        "uuid",
        "page_idx",
        (F.col("page_idx") + 1).alias("page"),
        "p.page_id",
        "p.template",
        "p.pdf_idx",
    )


def _document_fault(d: Column) -> Column:
    """First rule a result record breaks, or null."""

    def bad_highlight(h: Column) -> Column:
        box = field(h, "bounds")
        sides = [is_number(field(box, s)) for s in ("x", "y", "width", "height")]
        box_ok = (kind(box) == "VOID") | (kind(box).startswith("OBJECT") & sides[0] & sides[1] & sides[2] & sides[3])
        ok = (
            (kind(field(h, "text")) == "STRING")
            & is_number(field(h, "page_number"))
            & kind(field(h, "color")).isin("STRING", "VOID")
            & box_ok
            & (is_number(field(h, "created_at")) | (kind(field(h, "created_at")) == "VOID"))
        )
        return ~F.coalesce(ok, F.lit(False))

    def broken(test: Column) -> Column:
        return ~F.coalesce(test, F.lit(False))

    fault = F.when(broken(kind(d).startswith("OBJECT")), F.lit("not an object"))
    for name in ("uuid", "visible_name", "folder_path", "doc_type"):
        fault = fault.when(broken(kind(field(d, name)) == "STRING"), F.lit(name))
    for name in ("last_modified", "page_count"):
        fault = fault.when(broken(is_number(field(d, name))), F.lit(name))
    fault = fault.when(broken(kind(field(d, "has_pdf")) == "BOOLEAN"), F.lit("has_pdf"))
    fault = fault.when(broken(kind(field(d, "error")).isin("STRING", "VOID")), F.lit("error"))
    highlights = items(field(d, "highlights"))
    fault = fault.when(highlights.isNull(), F.lit("highlights"))
    return fault.when(F.exists(highlights, bad_highlight), F.lit("highlight"))


def quarantine_invalid(json_df: DataFrame, strict: bool = False) -> DataFrame:
    """Result payloads ``(payload_id, value)`` to one row per document with the rule it breaks.

    ``accepted`` follows the all-or-nothing rule: one bad document rejects its whole payload.  ``strict`` raises.
    """
    df = _parsed(json_df, ("success", "documents", "errors"))
    documents = items(F.col("j.documents"))
    whole = F.when(F.col("is_corrupt"), F.lit("malformed")).when(
        (F.coalesce(kind(F.col("j.success")), F.lit("")) != "BOOLEAN") | documents.isNull(), F.lit("structure")
    )
    checked = F.transform(documents, lambda d: F.struct(text(field(d, "uuid")).alias("uuid"), _document_fault(d).alias("fault")))
    df = df.withColumn("fault", whole).withColumn("docs", F.when(whole.isNull(), checked))
    accepted = F.col("fault").isNull() & ~F.exists(F.coalesce("docs", F.array().cast("array<struct<uuid:string,fault:string>>")), lambda d: d["fault"].isNotNull())
    if strict:
        message = F.concat(F.lit("invalid result payload "), F.col("payload_id").cast("string"))
        accepted = F.when(accepted, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    return (
        df.withColumn("accepted", accepted)
        .select("payload_id", "accepted", "fault", F.posexplode_outer("docs").alias("doc_idx", "d"))
        .select("payload_id", "doc_idx", "d.uuid", F.coalesce("fault", "d.fault").alias("reason"), "accepted")
    )


BOUNDS = "struct<x:double,y:double,width:double,height:double>"
# Optional fields of a document's record: type and value when the table does not have them.
RECORD = {
    "folder_path": ("string", ""),
    "has_pdf": ("boolean", None),
    "error": ("string", None),
    "warnings": ("array<string>", ()),
    "tags": ("array<string>", ()),
    "page_tags": ("array<struct<page:int,tags:array<string>>>", ()),
}


def emit_results_json(documents: DataFrame, highlights: DataFrame) -> DataFrame:
    """One JSON record per document with its highlights nested in order, in the form ``quarantine_invalid`` accepts.

    ``documents (doc, uuid, visible_name, doc_type, last_modified, page_count)`` may have the columns of RECORD, and
    ``highlights (doc, seq, text, page, color)`` bounds and created_at; what is absent is empty, ``has_pdf`` follows
    the document's type.
    """

    def own(df: DataFrame, name: str, kind: str) -> Column:
        return (F.col(name) if name in df.columns else F.lit(None)).cast(kind).alias(name)

    bounds, created = own(highlights, "bounds", BOUNDS), own(highlights, "created_at", "bigint")
    rows = highlights.select("doc", F.struct("seq", "text", F.col("page").alias("page_number"), "color", bounds, created).alias("h"))
    nested = rows.groupBy("doc").agg(F.array_sort(F.collect_list("h")).alias("h"))
    listed = F.coalesce("h", F.array().cast(nested.schema["h"].dataType))
    shaped = F.transform(listed, lambda h: h.dropFields("seq"))
    joined = documents.join(nested, "doc", "left")
    fields = {}
    for name, (kind, absent) in RECORD.items():
        value = own(documents, name, kind)
        if name == "has_pdf":
            value = F.coalesce(value, F.col("doc_type") == "pdf")
        elif absent is not None:
            value = F.coalesce(value, (F.array() if absent == () else F.lit(absent)).cast(kind))
        fields[name] = value.alias(name)
    head = ["uuid", "visible_name", fields["folder_path"], "doc_type", "last_modified", "page_count", fields["has_pdf"]]
    tail = [fields[n] for n in ("error", "warnings", "tags", "page_tags")]
    record = F.struct(*head, shaped.alias("highlights"), *tail)
    return joined.select("doc", F.to_json(record, {"ignoreNullFields": "false"}).alias("value"))
