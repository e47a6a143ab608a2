"""Parent chains: folder paths, trash, subtree counts, depth-first order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from marginalia.session import durable

KEY = ["source_id", "uuid"]
CHAIN = "array<struct<uuid:string,name:string>>"


def _written(df: DataFrame, open_rows: Column) -> tuple[DataFrame, int]:
    """``df`` written, and how many of its rows are open, counted as they are written."""
    seen = Observation()
    return durable(df.observe(seen, F.count_if(open_rows).alias("n"))), seen.get.get("n", 0)


def _climbed(nodes: DataFrame, whole: bool) -> DataFrame:
    """For nodes ``(source_id, uuid, parent, name, named)``: ``chain`` and ``stop``, the first parent that is no node.

    The chain holds the named nodes from the node up to the first one that is not named, the topmost first; with
    ``whole`` off it is empty.  Pointers double each round, so a tree of depth d takes about log2(d) rounds.  A row that
    has reached its stop leaves: later rounds look it up but do not write it again.  Nodes on a parent cycle, or below
    one, have no stop, and no chain if all of the cycle is named.
    """
    empty = F.array().cast(CHAIN)
    named = F.coalesce(F.col("named"), F.lit(False)) & F.lit(whole)
    known = nodes.select("source_id", F.col("uuid").alias("next"), F.lit(True).alias("found"))
    first = nodes.withColumnRenamed("parent", "next").join(known, ["source_id", "next"], "left")
    further = F.when(F.col("found"), F.col("next"))
    reach, waiting = _written(
        first.select(
            *KEY,
            further.alias("next"),
            F.when(F.col("found").isNull(), F.col("next")).alias("stop"),
            F.when(named, F.array(F.struct("uuid", "name"))).otherwise(empty).alias("chain"),
            (named & further.isNotNull()).alias("climbs"),
        ),
        F.col("next").isNotNull(),
    )
    done, before = reach.filter("next is null"), None
    # When no node resolved in a round, all that is left hangs on a cycle.
    while waiting not in (0, before):
        before = waiting
        rows = reach.filter("next is not null")
        hop = done.unionByName(rows).select(
            "source_id", F.col("uuid").alias("next"), F.col("next").alias("far"), F.col("stop").alias("far_stop"), F.col("chain").alias("above"), F.col("climbs").alias("above_climbs")
        )
        chain = F.when(F.col("climbs"), F.concat("above", "chain")).otherwise(F.col("chain"))
        reach, waiting = _written(
            rows.join(hop, ["source_id", "next"]).select(
                *KEY, F.col("far").alias("next"), F.col("far_stop").alias("stop"), chain.alias("chain"), (F.col("climbs") & F.col("above_climbs")).alias("climbs")
            ),
            F.col("next").isNotNull(),
        )
        done = done.unionByName(reach.filter("next is null"))
    hanging = reach.filter("next is not null").withColumn("chain", F.when(F.col("climbs"), empty).otherwise(F.col("chain")))
    return done.unionByName(hanging).select(*KEY, "chain", "stop")


def parent_chains(nodes: DataFrame, whole: bool = True) -> DataFrame:
    """For nodes ``(source_id, uuid, parent, name)``: ``chain`` from the root down to the node, and ``stop``, the
    first parent that is no node.  With ``whole`` off the chains are not built and empty.

    Nodes on a parent cycle, or below one, never reach a stop: their chain is empty and their stop null.
    """
    return _climbed(nodes.withColumn("named", F.lit(True)), whole)


def trashed_ids(entries: DataFrame) -> DataFrame:
    """Entries whose parent, or any ancestor, is ``'trash'``.  A parent cycle is not trashed."""
    parents = entries.select("source_id", F.col("parent").alias("uuid")).distinct()
    inner = parent_chains(entries.select("source_id", "uuid", "parent", "name").join(parents, KEY, "left_semi"), whole=False)
    in_trash = inner.filter(F.col("stop") == "trash").select("source_id", F.col("uuid").alias("parent"), F.lit(True).alias("below"))
    marked = entries.select("source_id", "uuid", "parent").join(in_trash, ["source_id", "parent"], "left")
    return marked.filter((F.col("parent") == "trash") | F.col("below")).select("source_id", "uuid")


def live_entries(entries: DataFrame) -> DataFrame:
    """Entries neither deleted nor in the trash."""
    return entries.filter(~F.col("deleted")).join(trashed_ids(entries), KEY, "left_anti")


def folder_chains(entries: DataFrame) -> DataFrame:
    folders = entries.filter(F.col("entry_type") == "CollectionType")
    return parent_chains(folders.select("source_id", "uuid", "parent", "name"))


def _with_chain(entries: DataFrame, chains: DataFrame) -> DataFrame:
    above = chains.select("source_id", F.col("uuid").alias("parent"), "chain")
    return entries.join(above, ["source_id", "parent"], "left")


def resolve_folder_paths(entries: DataFrame, live: bool = False) -> DataFrame:
    """Adds ``folder_path``, the names of the folders above an entry; ``''`` at the root or when the parent is unknown.

    With ``live`` only entries neither deleted nor in the trash stay, and only such folders count; one climb finds both.
    """
    if live:
        is_folder = (F.col("entry_type") == "CollectionType") & ~F.col("deleted")
        parents = entries.select("source_id", F.col("parent").alias("uuid")).distinct()
        nodes = entries.select(*KEY, "parent", "name", is_folder.alias("named")).join(parents, KEY, "left_semi")
        above = _climbed(nodes, True).select("source_id", F.col("uuid").alias("parent"), "chain", (F.col("stop") == "trash").alias("_below"))
        placed = entries.filter(~F.col("deleted")).join(above, ["source_id", "parent"], "left")
        trashed = F.coalesce(F.col("parent") == "trash", F.lit(False)) | F.coalesce("_below", F.lit(False))
        placed = placed.filter(~trashed).drop("_below")
    else:
        placed = _with_chain(entries, folder_chains(entries))
    path = F.when(F.size("chain") > 0, F.array_join(F.col("chain.name"), "/"))
    return placed.withColumn("folder_path", F.coalesce(path, F.lit(""))).drop("chain")


def _subtree_sums(folders: DataFrame, direct: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sums of ``direct`` (source_id, uuid, documents, subfolders) over the folders anywhere below each folder; and the
    folders that hang on a parent cycle, whose sums mean nothing.

    In round k every open folder knows the sum over the folders less than 2 ** k below it, itself included, and hands it
    to the folder 2 ** k above; then it looks twice as far up.  A folder without a folder that far above is done.
    So a round writes a row per open folder, however deep the tree.
    """
    known = folders.select("source_id", F.col("uuid").alias("next"))
    sums = ["documents", "subfolders"]
    start = folders.select(*KEY, F.col("parent").alias("next")).join(known, ["source_id", "next"]).join(direct, KEY, "left").fillna(0, sums)
    reach, waiting = _written(start.select(*KEY, "next", *sums), F.lit(True))
    handed, before = [], None
    while waiting not in (0, before):
        before = waiting
        given = reach.groupBy("source_id", F.col("next").alias("uuid")).agg(*[F.sum(c).alias(c) for c in sums])
        handed.append(given)
        hop = reach.select("source_id", F.col("uuid").alias("next"), F.col("next").alias("far"))
        got = given.select(*KEY, *[F.col(c).alias(f"more_{c}") for c in sums])
        more = [(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in sums]
        further = reach.join(hop, ["source_id", "next"]).join(got, KEY, "left").select(*KEY, F.col("far").alias("next"), *more)
        reach, waiting = _written(further, F.lit(True))
    below = reduce(DataFrame.unionByName, handed, direct.limit(0)).groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in sums])
    return below, reach.select(*KEY)


def folder_rollup(entries: DataFrame) -> DataFrame:
    """Per folder: documents and folders directly in it and anywhere below it, and whether it is empty throughout.

    A folder on a parent cycle, or below one, has nothing anywhere below it.
    """
    is_folder = F.col("entry_type") == "CollectionType"
    folders = entries.filter(is_folder).select(*KEY, "parent", "name")
    direct = durable(
        entries.groupBy("source_id", F.col("parent").alias("uuid"))
        .agg(F.count_if(~is_folder).alias("documents"), F.count_if(is_folder).alias("subfolders"))
        .join(folders.select(*KEY), KEY, "left_semi")
    )
    below, hanging = _subtree_sums(folders, direct)
    below = below.select(*KEY, F.col("documents").alias("docs_below"), F.col("subfolders").alias("folders_below"))
    hanging = hanging.withColumn("hangs", F.lit(True))
    counts = folders.select(*KEY, "name").join(direct, KEY, "left").join(below, KEY, "left").join(hanging, KEY, "left")
    counts = counts.fillna(0).fillna(False, ["hangs"])
    whole = lambda own, more: F.when(~F.col("hangs"), F.col(own) + F.col(more)).otherwise(0)
    counts = counts.withColumns({"all_documents": whole("documents", "docs_below"), "all_subfolders": whole("subfolders", "folders_below")})
    return counts.drop("docs_below", "folders_below", "hangs").withColumn("is_empty", F.col("all_documents") == 0)


def order_tree(entries: DataFrame) -> DataFrame:
    """Depth-first order: in each folder first its documents, then its folders, both by name.

    ``sort_path`` sorts that way; an entry whose parent is unknown belongs to the root.
    """
    is_folder = F.col("entry_type") == "CollectionType"
    step = F.struct(F.when(is_folder, 1).otherwise(0).alias("kind"), F.col("name"), F.col("uuid"))
    above = F.transform(F.coalesce("chain", F.array().cast(CHAIN)), lambda f: F.struct(F.lit(1).alias("kind"), f["name"].alias("name"), f["uuid"].alias("uuid")))
    placed = _with_chain(entries, folder_chains(entries)).withColumn("sort_path", F.concat(above, F.array(step)))
    return placed.withColumn("depth", F.size("sort_path") - 1).drop("chain").orderBy("source_id", "sort_path")
