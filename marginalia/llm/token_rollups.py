"""Token totals maintained by signed deltas (operator 9).

A change names a document, the count it had (``before``) and the count it has now (``after``), with the source,
language and tokenizer version of each.  An insert has no before, a delete no after.  Each change gives a row of
minus the old and a row of plus the new count; totals are additive, so a batch is summed by key first and only those
sums are kept.  A batch is committed once: the folder of its number appears with its sums in one step, and a repeated
batch finds it there and does nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["source", "lang", "tokenizer_version"]
SUMS = ["documents", "tokens"]
SIDE = "struct<source string, lang string, tokenizer_version string, tokens bigint>"
DELTAS = "source string, lang string, tokenizer_version string, documents long, tokens long"


def signed(changes: DataFrame) -> DataFrame:
    """Signed rows of ``changes`` (before, after); a change with neither gives none."""
    before, after = F.col("before").cast(SIDE), F.col("after").cast(SIDE)
    sides = F.array(F.struct(F.lit(-1).alias("sign"), before.alias("side")), F.struct(F.lit(1).alias("sign"), after.alias("side")))
    rows = changes.select(F.explode(sides).alias("s")).filter("s.side is not null")
    count = F.coalesce(F.col("s.side.tokens"), F.lit(0)) * F.col("s.sign")
    return rows.select(*[F.col(f"s.side.{k}") for k in KEYS], F.col("s.sign").cast("long").alias("documents"), count.alias("tokens"))


def summed(rows: DataFrame) -> DataFrame:
    """Null keys are keys of their own."""
    return rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])


class Rollups:
    """Totals in ``folder``, which every executor can reach: one folder of deltas per committed batch."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._files.mkdirs(self._path(f"{self.folder}/batches"))

    def committed(self) -> list[str]:
        found = self._files.listStatus(self._path(f"{self.folder}/batches"))
        return sorted(s.getPath().getName() for s in found)

    def apply(self, batch: int, changes: DataFrame) -> bool:
        """Commit ``changes`` as number ``batch``; False if that number is committed already."""
        name = f"{batch:012d}"
        if name in self.committed():
            return False
        attempt = f"{self.folder}/attempt-{uuid.uuid4().hex}"
        summed(signed(changes)).write.parquet(attempt)
        target = self._path(f"{self.folder}/batches/{name}")
        return not self._files.exists(target) and self._files.rename(self._path(attempt), target)

    def totals(self) -> DataFrame:
        """documents and tokens per key over all committed batches; keys with neither are left out.

        A key with tokens but no documents, or the other way round below zero, tells of changes that do not fit together.
        """
        paths = [f"{self.folder}/batches/{name}" for name in self.committed()]
        rows = self.spark.read.schema(DELTAS).parquet(*paths) if paths else self.spark.createDataFrame([], DELTAS)
        return summed(rows).filter("documents <> 0 or tokens <> 0")


def side(source: Column, lang: Column, version: Column, tokens: Column) -> Column:
    named = [source.alias("source"), lang.alias("lang"), version.alias("tokenizer_version"), tokens.cast("long").alias("tokens")]
    return F.struct(*named)


# Pattern tokenizers by version: the count is the number of matches; null texts have none.
VERSIONS = {"blank-1": "[^ \\x09-\\x0D]+", "piece-2": "[a-zA-Z]+|[0-9]|[^a-zA-Z0-9 \\x09-\\x0D]"}


def token_count(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


def counted(docs: DataFrame, text: Column, name: str) -> Column:
    """One entry per tokenizer version for ``text`` of ``docs``."""
    entries = [side(F.col("source"), F.col("lang"), F.lit(v), token_count(text, p)) for v, p in VERSIONS.items()]
    return F.array(*entries).alias(name)
