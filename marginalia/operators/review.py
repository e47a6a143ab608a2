"""Review of highlights: identifiers, state, summaries, export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import highlight_id, ordered_join
from marginalia.operators.notes import format_highlight


def with_highlight_id(df: DataFrame) -> DataFrame:
    """Adds ``id`` from ``uuid``, ``page`` and ``text``."""
    return df.withColumn("id", highlight_id(F.col("uuid"), F.col("page"), F.col("text")))


def _judgements(events: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """(highlight_id, moment, status, says, edited) of the events that judge; ``says`` is the moment of a word on the text."""
    edited = F.when(F.col("action") == "accept", F.col("edited_text"))
    status = (
        F.when(F.col("action") == "dismiss", "dismissed")
        .when(F.col("action") == "undo", "pending")
        .when(F.coalesce(F.col("edited_text"), F.lit("")) != "", "edited")
        .otherwise("accepted")
    )
    moment = F.struct(*order)
    marked = events.filter(F.col("action").isin("accept", "dismiss", "undo")).select(
        "highlight_id", moment.alias("moment"), status.alias("status"), edited.alias("edited")
    )
    # A dismissal says nothing about the text, so it is left out by a null ordering.
    return marked.withColumn("says", F.when(F.col("status") != "dismissed", F.col("moment")))


def reduce_review(events: DataFrame, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Latest state per highlight from ``(highlight_id, ts, action, edited_text)``; batch or stream.

    Accepting with a text means edited; dismissing keeps the text given before; undoing clears it.
    """
    return _judgements(events, order).groupBy("highlight_id").agg(
        F.max_by("status", "moment").alias("status"), F.max_by("edited", "says").alias("edited_text")
    )


def review_parts(events: DataFrame, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """One row per highlight that says what ``events`` say about it, and when, so that parts can be merged."""
    return merged_parts(_judgements(events, order))


def merged_parts(parts: DataFrame) -> DataFrame:
    """Parts of the same highlights as one; ``status`` and ``edited`` are those of ``reduce_review`` over all their events."""
    return parts.groupBy("highlight_id").agg(
        F.max("moment").alias("moment"), F.max_by("status", "moment").alias("status"), F.max("says").alias("says"), F.max_by("edited", "says").alias("edited")
    )


def with_review_state(highlights: DataFrame, state: DataFrame) -> DataFrame:
    """Every highlight with its status; ``pending`` when nobody looked at it."""
    known = state.withColumnRenamed("highlight_id", "id")
    return highlights.join(known, "id", "left").withColumn("status", F.coalesce("status", F.lit("pending")))


def pending_review(highlights: DataFrame, state: DataFrame) -> DataFrame:
    """Highlights still to be judged, dismissed ones included."""
    return with_review_state(highlights, state).filter(~F.col("status").isin("accepted", "edited"))


def review_summary(df: DataFrame) -> DataFrame:
    """Counts over the full state ``(uuid, status)``."""
    status = F.col("status")
    return df.agg(
        F.count_distinct(F.when(status == "pending", F.col("uuid"))).alias("documents_with_pending"),
        F.count_if(status == "pending").alias("total_pending"),
        F.count_if(status.isin("accepted", "edited")).alias("total_accepted"),
        F.count_if(status == "dismissed").alias("total_dismissed"),
    )


def accepted_export(df: DataFrame) -> DataFrame:
    """Per document the accepted and edited texts as quotes, in the order of ``seq``."""
    text = F.coalesce("edited_text", "text")
    colour = F.coalesce("color", F.lit(""))
    block = F.concat(format_highlight(text, F.col("page"), colour, F.col("pdf_name"), True, "pdfpp"), F.lit("\n"))
    accepted = df.filter(F.col("status").isin("accepted", "edited"))
    return accepted.groupBy("uuid").agg(ordered_join(block, "\n", "seq").alias("body"))
