"""Fleets of devices: health checks, outages, secrets in logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.ids import at_least, version
from marginalia.operators.ordered import HOT_ROWS, OrderedGroups

# Secrets as they occur in logged commands, the oldest and the newest version known to work.
SECRETS = (
    "(?i)(X-API-Key:\\s*)[^'\"\\s]+",
    "(SSHPASS=)\\S+",
    "(sshpass\\s+-p\\s*)\\S+",
    "(?i)(--password[=\\s]+)\\S+",
)
MIN_VERSION = (2, 6)
NEWER_PACKAGES = (3, 4)
SCENE_FORMAT = (3, 0)
KNOWN_GOOD = (3, 26)
FULL_ROOT = 95
FIRST_MODEL_MB = 600
SECOND_MODEL_MB = 1200


def redact_secrets(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mask credentials in text columns, keeping what stands before them."""

    def masked(text: Column) -> Column:
        for pattern in SECRETS:
            text = F.regexp_replace(text, pattern, "$1***")
        return text

    return df.withColumns({c: masked(F.col(c)) for c in columns})


def failure_streaks(
    events: DataFrame,
    n: int = 3,
    key: str = "key",
    order: tuple[str, ...] = ("ts",),
    before: DataFrame | None = None,
    limit: int = HOT_ROWS,
) -> DataFrame:
    """Adds ``streak``, consecutive failures so far, and ``alert`` on the n-th of each outage; a success resets.

    ``before (key, streak)`` continues streaks that began earlier.
    """
    failed = F.when(F.col("failed"), 1).otherwise(0)
    groups = OrderedGroups(events, [key], list(order), limit).running_sum("_failures", failed)
    groups.running_max("_settled", F.when(~F.col("failed"), F.col("_failures")))
    df = groups.result()
    earlier = F.lit(0)
    if before is not None:
        df = df.join(before.select(key, F.col("streak").alias("_before")), key, "left")
        earlier = F.coalesce("_before", F.lit(0))
    streak = F.col("_failures") - F.coalesce(F.col("_settled"), -earlier)
    df = df.withColumn("streak", streak.cast("bigint"))
    return df.withColumn("alert", F.col("failed") & (F.col("streak") == n)).drop("_failures", "_settled", "_before")


def version_support(df: DataFrame) -> DataFrame:
    """Adds the parsed version of ``fw``, its support class, package path and stroke format family."""
    v = F.col("version")
    tested = (v["major"] == KNOWN_GOOD[0]) & (v["minor"] <= KNOWN_GOOD[1])
    support = (
        F.when(v.isNull(), "malformed")
        .when(~at_least(v, *MIN_VERSION), "unsupported")
        .when(tested, "tested")
        .when(at_least(v, *KNOWN_GOOD), "newer")
        .otherwise("older")
    )
    path = F.when(at_least(v, *MIN_VERSION), F.when(at_least(v, *NEWER_PACKAGES), "entware").otherwise("toltec"))
    parsed = df.withColumn("version", version(F.col("fw")))
    return parsed.withColumns({"support": support, "install_path": path, "scene_format": at_least(v, *SCENE_FORMAT)})


def model_by_memory(total_mb: Column) -> Column:
    """Device generation when only its memory is known."""
    return F.when(total_mb < FIRST_MODEL_MB, "model1").when(total_mb < SECOND_MODEL_MB, "model2").otherwise("unknown")


def device_health(devices: DataFrame, budgets: DataFrame) -> DataFrame:
    """One row per device and check with severity and result; ``device_passed`` when no check of severity error failed.

    ``budgets (model, sync_memory_mb, min_free_memory_mb, min_free_storage_mb)``; a model without a budget takes the
    one of ``unknown``, and where there is none either, no limits hold.  A device whose model could not be read is judged
    by its memory.  Where no installation path can be told from the version, a failed check says so.
    """
    read = F.nullif(F.trim("model"), F.lit(""))
    devices = devices.withColumn("model", F.coalesce(read, model_by_memory(F.col("mem_total_mb"))))
    named = budgets.withColumnRenamed("model", "b_model")
    known = budgets.select(F.col("model").alias("b_model"))
    matched = devices.join(known.withColumn("has_budget", F.lit(True)), devices["model"] == F.col("b_model"), "left").drop("b_model")
    matched = matched.withColumn("b_model", F.when(F.col("has_budget"), F.col("model")).otherwise(F.lit("unknown")))
    limits = ["sync_memory_mb", "min_free_memory_mb", "min_free_storage_mb"]
    df = version_support(matched.join(named, "b_model", "left").fillna(0, limits))

    def mount(path: str) -> Column:
        return F.get(F.filter("storage", lambda s: s["mount"] == path), F.lit(0))

    home, root, free = mount("/home"), mount("/"), F.col("mem_avail_mb")
    low_memory = free < F.col("min_free_memory_mb")
    tight_memory = free < F.col("min_free_memory_mb") + F.col("sync_memory_mb")
    no_home = home.isNull() | (home["avail_mb"] < F.col("min_free_storage_mb"))
    bad_version = F.col("support").isin("malformed", "unsupported")

    def check(name: str, passed: Column, severity: Column) -> Column:
        return F.struct(F.lit(name).alias("check"), passed.alias("passed"), severity.alias("severity"))

    def graded(error: Column, warning: Column) -> Column:
        return F.when(error, "error").when(warning, "warning").otherwise("info")

    never = F.lit(False)
    checks = F.array(
        check("firmware", ~bad_version, graded(bad_version, F.col("support") != "tested")),
        check("memory", ~low_memory, graded(low_memory, tight_memory)),
        check("home_storage", ~no_home, graded(no_home, never)),
        check("root_partition", F.lit(True), graded(never, root.isNull() | (root["used_pct"] > FULL_ROOT))),
        check("store", F.col("store_exists"), graded(~F.col("store_exists"), never)),
        check("model", F.lit(True), F.lit("warning")),
    )
    no_path = F.array(check("installation_path", never, F.lit("error")))
    listed = df.withColumn("checks", F.when(F.col("install_path").isNull(), F.concat(checks, no_path)).otherwise(checks))
    passed = ~F.exists("checks", lambda k: (k["severity"] == "error") & ~k["passed"])
    return listed.select("device_id", passed.alias("device_passed"), F.inline("checks"))
