"""A keyed table in buckets and generations, kept up by a function for ``foreachBatch``.

A batch reads the buckets that its keys fall into and writes these anew, or adds to them, as generation ``n``; all other
buckets stay as they are.  A manifest per batch, written last, lists the generations of each bucket.  Batch ``n`` starts
from manifest ``n - 1``, so a repeated batch writes the same again.  What neither of the two lists is removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET = "bucket"


def path_and_files(spark: SparkSession, path: str):
    """The path and its file system, as the cluster configures it."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


class Buckets:
    """The table in ``folder``; ``schema`` is that of its rows, without the bucket."""

    def __init__(self, spark: SparkSession, folder: str, schema, buckets: int):
        self.spark, self.folder, self.schema, self.buckets = spark, folder.rstrip("/"), schema, buckets

    def bucket(self, *key: str) -> Column:
        return F.pmod(F.xxhash64(*key), F.lit(self.buckets)).cast("int").alias(BUCKET)

    def manifest(self, number: int) -> dict[int, list[int]]:
        """The generations of each bucket after batch ``number``; at most a few per bucket."""
        if number < 0:
            return {}
        rows = self.spark.read.schema("bucket int, generation long").parquet(f"{self.folder}/manifest/batch={number}").collect()
        found: dict[int, list[int]] = {}
        for bucket, generation in sorted(tuple(r) for r in rows):
            found.setdefault(bucket, []).append(generation)
        return found

    def last_batch(self) -> int:
        place, files = path_and_files(self.spark, f"{self.folder}/manifest")
        if not files.exists(place):
            return -1
        return max((int(s.getPath().getName().split("=")[1]) for s in files.listStatus(place)), default=-1)

    def rows(self, manifest: dict[int, list[int]], wanted=None) -> DataFrame:
        """Rows of the ``wanted`` buckets, or of all, with the bucket; no other bucket's files are listed or read."""
        paths = [self._place(g, b) for b, gs in manifest.items() if wanted is None or b in wanted for g in gs]
        if not paths:
            empty = self.spark.createDataFrame([], self.schema)
            return empty.withColumn(BUCKET, F.lit(None).cast("int"))
        read = self.spark.read.option("basePath", f"{self.folder}/data").schema(self.schema).parquet(*paths)
        return read.withColumn(BUCKET, F.col(BUCKET).cast("int")).drop("generation")

    def _place(self, generation: int, bucket: int) -> str:
        return f"{self.folder}/data/generation={generation}/{BUCKET}={bucket}"

    def commit(self, number: int, rows: DataFrame, touched: set[int], added: bool = False, most: int = 1) -> None:
        """Write ``rows`` (with their bucket) as generation ``number`` of the ``touched`` buckets.

        They replace what these buckets held.  With ``added`` they join it, until a bucket has ``most`` generations;
        such a bucket is written as one.
        """
        before = self.manifest(number - 1)
        whole = {b for b in touched if added and len(before.get(b, [])) >= most}
        if whole:
            rows = rows.unionByName(self.rows(before, whole).select(*rows.columns))
        rows.repartition(min(self.buckets, max(1, len(touched))), BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(
            f"{self.folder}/data/generation={number}"
        )
        place, files = path_and_files(self.spark, f"{self.folder}/data/generation={number}")
        written = {int(s.getPath().getName().split("=")[1]) for s in files.listStatus(place) if "=" in s.getPath().getName()}
        after = {b: gs for b, gs in before.items() if b not in touched or (added and b not in whole)}
        for b in written:
            after[b] = [*after.get(b, []), number]
        listed = [(b, g) for b, gs in after.items() for g in gs]
        manifest = self.spark.createDataFrame(listed, "bucket int, generation long").coalesce(1)
        manifest.write.mode("overwrite").parquet(f"{self.folder}/manifest/batch={number}")
        if number >= 2:
            kept = {(b, g) for b, gs in before.items() for g in gs} | set(listed)
            self._prune(number, kept)

    def _prune(self, number: int, kept: set[tuple[int, int]]) -> None:
        place, files = path_and_files(self.spark, f"{self.folder}/manifest")
        old = [n for n in (int(s.getPath().getName().split("=")[1]) for s in files.listStatus(place)) if n < number - 1]
        for n in sorted(old):
            for b, gs in self.manifest(n).items():
                for g in gs:
                    if (b, g) not in kept:
                        files.delete(path_and_files(self.spark, self._place(g, b))[0], True)
            files.delete(path_and_files(self.spark, f"{self.folder}/manifest/batch={n}")[0], True)
