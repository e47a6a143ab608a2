"""License scans (operator 5): MinHash bands over overlapping windows retrieve templates, exact containment verifies.

Built of DataFrame functions only.  Words are runs of ASCII letters and digits in lower case, a shingle is five words.
A template of s shingles is sought in every window of s + s // 2 shingles (s below four), whatever its start, so that up
to s // 2 shingles of inserted words do not hide it at any place of a text; the window must hold 80 % of them.

Retrieval: templates fall into classes by the power of two that their length reaches.  For a class with windows of up to
m shingles a text is cut into windows of 2 m that start every m, so each window of a template lies whole in one.  Of the
shingles in it those of the class's templates count.  A match then has a Jaccard similarity with its template of at
least 0.8 s / (2 m + 0.2 s), mostly more; MINHASHES bands of one value each miss it with probability (1 - J) ** MINHASHES:
under 1e-6 for each template of TEMPLATES.

Verification: how many of the template's shingles the windows at each start hold is a running sum over the places of a
retrieved window: a shingle at place q, last met at place p, counts for the starts after max(p, q - length) up to q.

Before that, texts that cannot hold any template are passed over without loss: the longest words of each template that
stand in more of its shingles than a match may lack.  Where none of these words stands there is no match.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import cached_property
from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import stored
from marginalia.llm.quality import bind

SHINGLE = 5
BROADCAST_SHINGLES = 200_000
MINHASHES = 128
LEAST = 80


@dataclass(frozen=True)
class Template:
    license_id: str
    text: str

    @cached_property
    def words(self) -> list[str]:
        return re.findall("[a-z0-9]+", self.text.lower())

    @property
    def shingles(self) -> int:
        return len(self.distinct)

    @cached_property
    def distinct(self) -> set[tuple[str, ...]]:
        """Distinct shingles; a text of under five words is one."""
        words = self.words
        return {tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))}

    @property
    def window(self) -> tuple[int, int]:
        """(length in shingles, step): windows start at every shingle."""
        size = max(1, len(self.words) - SHINGLE + 1)
        return size + size // 2 if size >= 4 else size, 1

    @property
    def span(self) -> int:
        """Places that the window of a template of this class may have: 1.5 times a power of two."""
        size = max(1, len(self.words) - SHINGLE + 1)
        reach = 1 << (size - 1).bit_length()
        return reach + reach // 2

    @property
    def miss(self) -> float:
        """The most likely a match can be to share no MinHash value with the template."""
        least = LEAST / 100 * self.shingles
        return (1 - least / (2 * self.span + self.shingles - least)) ** MINHASHES

    @cached_property
    def gate(self) -> list[str]:
        """Words of which every shingle holds one: as long ones as possible, then as few as possible."""
        words = self.words
        starts = range(max(1, len(words) - SHINGLE + 1))
        for least in sorted({len(w) for w in words}, reverse=True):
            chosen, place = [], -1
            for i in starts:
                if place < i:
                    fitting = [j for j in range(i, min(i + SHINGLE, len(words))) if len(words[j]) >= least]
                    if not fitting:
                        break
                    place = fitting[-1]
                    chosen.append(words[place])
            else:
                return chosen
        return []

    @cached_property
    def anchors(self) -> list[str]:
        """Words of ``gate``, long ones in many shingles first, that stand in more than a match may lack: each match has one."""
        left, chosen = self.distinct, []
        least = -(-LEAST * self.shingles // 100)
        often = Counter(word for shingle in self.distinct for word in set(shingle))
        for word in sorted(set(self.gate), key=lambda w: (len(w) < 6, -often[w], w)):
            if len(left) < least:
                break
            chosen.append(word)
            left = {shingle for shingle in left if word not in shingle}
        return chosen


def given() -> tuple[Template, ...]:
    """The folder license_texts: whole texts, a file each, and notices, a line of id and wording each."""
    folder = files("marginalia.llm") / "license_texts"
    texts = sorted((f for f in folder.iterdir() if f.name.endswith(".txt")), key=lambda f: f.name)
    lines = (folder / "notices.tsv").read_text(encoding="utf-8").splitlines()
    whole = [Template(f.name.removesuffix(".txt"), f.read_text(encoding="utf-8")) for f in texts]
    return (*whole, *(Template(*line.split("\t")) for line in lines))


# Notices in common use: fixed values.  Texts of one license_id differ in their number of shingles or have one.
TEMPLATES = (
    Template("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    Template("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    Template("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    Template("MIT", "Released under the MIT License."),
    Template("BSD-notice", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    Template(
        "MIT-notice",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files, to deal in the Software without restriction",
    ),
    *given(),
)


def shingles_of(words: Column) -> Column:
    """Hashes of the shingles in order; a text of under five words but not none is one shingle."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - SHINGLE + 1))
    every = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, SHINGLE)))
    return F.when(F.size(words) > 0, every).otherwise(F.array().cast("array<bigint>"))


def templates_table(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    """(template, license_id, length, span, total, shingle), a row per distinct shingle of a template."""
    lines = [(i, t.license_id, t.words, t.window[0], t.span, t.shingles) for i, t in enumerate(templates) if t.words]
    table = spark.createDataFrame(lines, "template int, license_id string, words array<string>, length int, span int, total long")
    shingle = F.explode(F.array_distinct(shingles_of(F.col("words")))).alias("shingle")
    return table.select("template", "license_id", "length", "span", "total", shingle)


def minhashes(groups) -> DataFrame:
    """A row per group and band: the band's number and the least hash that its function gives to the shingles."""
    values = groups.agg(*[F.min(F.xxhash64("shingle", F.lit(i))).alias(f"h{i}") for i in range(MINHASHES)])
    keys = [c for c in values.columns if c not in {f"h{i}" for i in range(MINHASHES)}]
    return values.select(*keys, F.posexplode(F.array(*[f"h{i}" for i in range(MINHASHES)])).alias("band", "value"))


def fullest(hits: Column, length: Column, total: Column) -> Column:
    """(n, best, first) of ``hits`` (shingle, place): the most distinct shingles of a window and the first start with enough."""

    def counted(ordered: Column) -> Column:
        def change(hit: Column, i: Column) -> Column:
            twin = F.get(ordered, i - 1)
            before = F.when(twin["shingle"] == hit["shingle"], twin["place"]).otherwise(F.lit(-1))
            enters = F.greatest(F.lit(0), before + 1, hit["place"] - length + 1)
            step = lambda at, by: F.struct(at.alias("at"), F.lit(by).cast("long").alias("by"))
            return F.array(step(enters, 1), step(hit["place"] + 1, -1))

        return F.array_sort(F.flatten(F.transform(ordered, change)))

    def swept(state: Column, event: Column) -> Column:
        n = state["n"] + event["by"]
        first = F.coalesce(state["first"], F.when(100 * n >= LEAST * total, event["at"].cast("long")))
        return F.struct(n.alias("n"), F.greatest(state["best"], n).alias("best"), first.alias("first"))

    zero = F.lit(0).cast("long")
    # Of events at one place those that take away come first, so no sum on the way is more than that of a start.
    start = F.struct(zero.alias("n"), zero.alias("best"), F.lit(None).cast("long").alias("first"))
    return F.aggregate(bind(F.array_sort(hits), counted), start, swept)


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """A row per document and license found: doc_id, license_id, n_found, n_shingles, containment, first_word.

    ``n_found`` is the most distinct shingles of the template in one window, which must be 80 % of them;
    ``first_word`` is where the first such window starts.  Null and empty texts hold none; rows that share a doc_id,
    null included, are reported together.  Further columns are ignored.  Templates of up to BROADCAST_SHINGLES shingles
    are broadcast, more are joined by a shuffle.  A task holds the shingles of one window, at most six template lengths.
    """
    words = sorted({w for t in templates if t.words for w in t.anchors})
    gate = "(?<![a-z0-9])(?:" + "|".join(words) + ")(?![a-z0-9])" if words else "(?!)"
    lower = docs.select("doc_id", F.lower(F.col("text").cast("string")).alias("lower")).filter(F.col("lower").rlike(gate))
    # Rows of one doc_id and text have the same hits, so these two name a row.
    own = F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit(""))
    row = F.md5(F.concat(own, F.lit(" "), "lower"))
    split = lower.select("doc_id", row.alias("row"), F.regexp_extract_all("lower", F.lit("[a-z0-9]+"), 0).alias("words"))
    spread = split.select("doc_id", "row", F.posexplode(shingles_of(F.col("words"))).alias("place", "shingle"))
    few = sum(t.shingles for t in templates) <= BROADCAST_SHINGLES
    known = templates_table(docs.sparkSession, templates)
    known, side = (F.broadcast(known), F.broadcast) if few else (known, lambda df: df)
    hits = stored(spread.join(side(known.select("shingle").distinct()), "shingle").distinct(), "license-shingles")

    # A place lies in two windows of each class that has its shingle.
    at = F.floor(F.col("place") / F.col("span"))
    both = F.explode(F.array_distinct(F.array(F.greatest(F.lit(0), at - 1), at))).alias("window")
    placed = hits.join(side(known.select("shingle", "span").distinct()), "shingle").select("doc_id", "row", "span", both, "place", "shingle")
    window = ["row", "span", "window"]
    sought = side(minhashes(known.groupBy("template", "span")))
    retrieved = minhashes(placed.groupBy(*window)).join(sought, ["span", "band", "value"]).select(*window, "template").distinct()

    met = placed.join(retrieved, window).join(known.drop("span"), ["template", "shingle"])
    held = met.groupBy("doc_id", *window, "template", "license_id", "length", "total").agg(F.collect_set(F.struct("shingle", "place")).alias("hits"))
    held = held.filter(100 * F.size(F.array_distinct("hits.shingle")) >= LEAST * F.col("total"))
    found = held.select("doc_id", "license_id", "total", fullest(F.col("hits"), F.col("length"), F.col("total")).alias("w"))
    best = found.filter(F.col("w.first").isNotNull()).groupBy("doc_id", "license_id").agg(
        F.max("w.best").alias("n_found"), F.max("total").alias("n_shingles"), F.min("w.first").alias("first_word")
    )
    return best.withColumn("containment", F.col("n_found") / F.col("n_shingles"))
