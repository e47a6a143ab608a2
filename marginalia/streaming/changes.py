"""Change feeds, review state and alerts as streams.  Each function also takes a batch DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from marginalia.functions.ids import extension
from marginalia.operators.catalog import classify_readiness, since
from marginalia.operators.ordered import HOT_ROWS, OrderedGroups
from marginalia.operators.review import merged_parts, review_parts
from marginalia.operators.runs import next_cursor
from marginalia.streaming.buckets import BUCKET, Buckets

# Endings that count as a change, names that do not.
WATCHED = [".rm", ".metadata", ".content"]


def relevant_changes(changes: DataFrame, ignored: DataFrame) -> DataFrame:
    """Changes ``(ts, source_id, path)`` of watched files, without conflict and temporary copies, and without
    documents in ``ignored (uuid)``."""
    path = F.col("path")
    name = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    spare = path.contains("sync-conflict") | path.contains(".syncthing.") | path.endswith(".tmp")
    watched = changes.filter(extension(F.element_at(F.split(path, "/"), -1)).isin(WATCHED) & ~spare)
    owned = watched.withColumn("owner", F.regexp_extract(name, "^([^./]*)", 1))
    return owned.join(ignored.select(F.lower("uuid").alias("owner")), "owner", "left_anti").drop("owner")


def debounced_changes(
    changes: DataFrame, ignored: DataFrame, gap_seconds: int = 10, watermark: str = "10 minutes", limit: int = HOT_ROWS
) -> DataFrame:
    """One trigger per quiet period of a source: when it is due and how many changes it covers.

    A stream uses session windows and emits a trigger once the watermark passes its end; under ``run.SETTINGS`` each task
    merges the sessions of its own rows first, so a source that has most of the rows comes to its task as a few partial
    sessions.  A batch cuts the ordered changes at quiet gaps, which also holds when one source has most of the rows.
    """
    kept = relevant_changes(changes, ignored)
    gap = F.expr(f"INTERVAL {gap_seconds} SECONDS")
    if changes.isStreaming:
        session = F.session_window("ts", f"{gap_seconds} seconds")
        counted = kept.withWatermark("ts", watermark).groupBy("source_id", session.alias("s")).agg(F.count(F.lit(1)).alias("changes"))
        return counted.select("source_id", F.col("s.start").alias("first_ts"), F.col("s.end").alias("due_ts"), "changes")
    # Equal times never cut a period, so their order among each other does not matter.
    groups = OrderedGroups(kept, ["source_id"], ["ts", "path"], limit, changes).previous("_before", F.col("ts"))
    quiet = F.col("_before").isNull() | (F.col("ts") >= F.col("_before") + gap)
    periods = groups.running_sum("_period", F.when(quiet, 1).otherwise(0)).result()
    return (
        periods.groupBy("source_id", "_period")
        .agg(F.min("ts").alias("first_ts"), (F.max("ts") + gap).alias("due_ts"), F.count(F.lit(1)).alias("changes"))
        .drop("_period")
    )


def dedupe_highlights(highlights: DataFrame) -> DataFrame:
    """Each highlight ``id`` of a batch once."""
    return highlights.dropDuplicates(["id"])


def publish_new_highlights(folder: str, buckets: int = 64, generations: int = 8) -> Callable[[DataFrame, int], None]:
    """Function for ``foreachBatch``: highlights whose ``id`` no earlier batch had go to ``folder/batch=n``.

    Identifiers are never forgotten.  They lie in ``folder/_ids`` by hash, and a batch reads those of the buckets its own
    identifiers fall into.  A bucket is written as one again after ``generations`` additions.  A repeated batch looks at
    the batches before it alone, so it writes the same again.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = Buckets(spark, f"{folder}/_ids", batch.select("id").schema, buckets)
        fresh = dedupe_highlights(batch).withColumn(BUCKET, known.bucket("id")).persist()
        touched = {r[0] for r in fresh.select(BUCKET).distinct().collect()}
        before = known.rows(known.manifest(number - 1), touched)
        fresh.join(before.select("id"), "id", "left_anti").select(*batch.columns).write.mode("overwrite").parquet(f"{folder}/batch={number}")
        added = spark.read.schema(batch.schema).parquet(f"{folder}/batch={number}").select("id", known.bucket("id"))
        known.commit(number, added, touched, added=True, most=generations)
        fresh.unpersist()

    return run


def keep_review_state(folder: str, order: tuple[str, ...] = ("ts",), buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """Function for ``foreachBatch`` over review events: the state of all highlights lies in ``folder``, by hash.

    A batch is reduced to a row per highlight and merged into the buckets these fall into; events may come in any order
    and in any batch.  Old generations are removed, and a repeated batch changes nothing.
    """

    def run(batch: DataFrame, number: int) -> None:
        parts = review_parts(batch, order)
        state = Buckets(batch.sparkSession, folder, parts.schema, buckets)
        parts = parts.withColumn(BUCKET, state.bucket("highlight_id")).persist()
        touched = {r[0] for r in parts.select(BUCKET).distinct().collect()}
        before = state.rows(state.manifest(number - 1), touched)
        merged = merged_parts(before.unionByName(parts)).withColumn(BUCKET, state.bucket("highlight_id"))
        state.commit(number, merged, touched)
        parts.unpersist()

    return run


def review_state(events: DataFrame, folder: str, order: tuple[str, ...] = ("ts",), buckets: int = 64) -> DataFrame:
    """What ``keep_review_state`` has in ``folder``, as ``reduce_review`` gives it; ``events`` lends its schema alone."""
    kept = Buckets(events.sparkSession, folder, review_parts(events, order).schema, buckets)
    return kept.rows(kept.manifest(kept.last_batch())).select("highlight_id", "status", F.col("edited").alias("edited_text"))


class Streaks(StatefulProcessor):
    """Per key the length of the outage that is going on; without one there is no state."""

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.streak = handle.getValueState("streak", "streak long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        chunks = list(rows)
        at, seq, failed = (np.concatenate([c[name].to_numpy() for c in chunks]) for name in ("at_us", "seq", "failed"))
        order = np.lexsort((seq, at))
        at, failed = at[order], failed[order] == True  # noqa: E712  null is no failure
        before = self.streak.get()[0] if self.streak.exists() else 0
        failures = failed.cumsum()
        streak = failures - np.maximum.accumulate(np.where(failed, -before, failures))
        if streak[-1] and streak[-1] != before:
            self.streak.update((int(streak[-1]),))
        elif before and not streak[-1]:
            self.streak.clear()
        alerts = failed & (streak == self.n)
        if alerts.any():
            yield pd.DataFrame({"key": key[0], "at_us": at[alerts], "streak": streak[alerts]})

    def close(self) -> None:
        pass


def streak_alerts(outcomes: DataFrame, n: int = 3) -> DataFrame:
    """Stream of ``(key, ts, streak)``, the n-th failure of each outage, from a stream ``(key, ts, seq, failed)``.

    The length of a going outage is a value in the state store; a batch writes it for the keys whose outage went on,
    began or ended.  Rows of a batch are taken in order of ``ts`` and ``seq``, batches as they come; a null outcome is no
    failure, and a null key is one.  The rows of a key in one batch are held by its task, so a trigger's limit bounds
    them.  ``run.SETTINGS`` must hold when the stream starts, as ``run.run_batches`` sees to.
    """
    rows = outcomes.select("key", F.unix_micros("ts").alias("at_us"), "seq", "failed")
    key_type = outcomes.schema["key"].dataType.simpleString()
    found = rows.groupBy("key").transformWithStateInPandas(Streaks(n), f"key {key_type}, at_us long, streak long", "Update", "None")
    return found.select("key", F.timestamp_micros("at_us").alias("ts"), "streak")


def pending_hold(entries: DataFrame, contents: DataFrame, runs: DataFrame, prev: DataFrame, paths: DataFrame) -> DataFrame:
    """Cursors after a run in which documents without usable content hold their source back until they arrive."""
    ready = classify_readiness(entries, contents).select("source_id", "last_modified", "readiness")
    return next_cursor(ready, runs, prev, paths)


def incremental_upkeep(
    folder: str, publish: Callable[[DataFrame, int], DataFrame], start: DataFrame, paths: DataFrame
) -> Callable[[DataFrame, int], None]:
    """Function for ``foreachBatch`` over arriving documents ``(source_id, uuid, doc_type, last_modified, readiness)``.

    ``start (source_id, cursor_ms, path_hash)`` says what was published before the stream began; whatever arrives
    ready and is newer than that is published, in whatever order it comes.  A document that is not ready waits in a
    table until it arrives ready; while any document of a source waits, the source's cursor stays, and when none does
    it moves to the newest document seen ready in any batch, under the rules of ``next_cursor``.

    ``publish`` returns ``runs (source_id, full_scan, errors, clean_transfer)`` and must overwrite its output for the
    same batch number.  The waiting documents and the cursors of each batch lie in ``folder/waiting`` and
    ``folder/cursors``; a batch reads those of the one before and writes its own, the cursors last, so a repeated
    batch changes nothing.
    """
    columns = ["source_id", "uuid", "last_modified", "readiness"]

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        arrived = batch.select(*columns)
        cursors, held = start, arrived.limit(0)
        if number:
            cursors = spark.read.parquet(f"{folder}/cursors/batch={number - 1}")
            held = spark.read.schema(arrived.schema).parquet(f"{folder}/waiting/batch={number - 1}")
        outcome = publish(since(batch.filter(F.col("readiness") == "ready"), start), number)
        # Of a document in one batch the newest row counts; what is held without a uuid is the newest time seen ready.
        latest = F.max_by("readiness", F.struct("last_modified", F.col("readiness") == "ready")).alias("readiness")
        fresh = arrived.groupBy("source_id", "uuid").agg(F.max("last_modified").alias("last_modified"), latest)
        left = held.filter("uuid is not null").join(fresh, ["source_id", "uuid"], "left_anti")
        waiting = left.unionByName(fresh.filter("readiness <> 'ready'"))
        ready = arrived.filter("readiness = 'ready'").unionByName(held.filter("uuid is null"))
        newest = ready.groupBy("source_id").agg(F.max("last_modified").alias("last_modified"))
        newest = newest.withColumns({"uuid": F.lit(None).cast("string"), "readiness": F.lit("ready")})
        waiting.unionByName(newest).write.mode("overwrite").parquet(f"{folder}/waiting/batch={number}")
        known = spark.read.schema(arrived.schema).parquet(f"{folder}/waiting/batch={number}")
        advanced = next_cursor(known, outcome, cursors, paths)
        advanced.select("source_id", "cursor_ms", "path_hash").write.mode("overwrite").parquet(f"{folder}/cursors/batch={number}")
        batch.unpersist()

    return run
