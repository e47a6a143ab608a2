"""Run a stream over everything that has arrived and leave its result as a table."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.session import shared_folder

# What a stream reads when it starts.  Sessions are merged in each task before they are dealt by key, so a busy source
# reaches its one task as a few partial sessions.  State of ``transformWithState`` lies in RocksDB, of which a batch writes
# the changes.
SETTINGS = {
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


@contextmanager
def stream_settings(spark: SparkSession) -> Iterator[None]:
    """SETTINGS while a stream is started; the caller's own settings afterwards."""
    before = {name: spark.conf.get(name, None) for name in SETTINGS}
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/streams/{uuid.uuid4()}"


def run_to_table(stream: DataFrame, mode: str, folder: str) -> DataFrame:
    """Append: one subfolder per batch, written again when the batch is.  Complete: the last batch is the result."""

    def write(batch: DataFrame, number: int) -> None:
        target = f"{folder}/data/batch={number}" if mode == "append" else f"{folder}/data/whole"
        batch.write.mode("overwrite").parquet(target)

    run_batches(stream, mode, folder, write)
    path = f"{folder}/data" if mode == "append" else f"{folder}/data/whole"
    df = stream.sparkSession.read.parquet(path)
    return df.select(*stream.columns)


def to_folder(folder: str):
    """Function for ``foreachBatch``: a subfolder per batch, written again when the batch is."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return write


def newest_rows(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """Of the rows that batches in update mode left in ``folder``, the last of each key."""
    rows = spark.read.parquet(folder)
    columns = [c for c in rows.columns if c != "batch"]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), "batch").alias("row")).select("row.*")


def run_batches(stream: DataFrame, mode: str, folder: str, handle) -> None:
    """Hand every batch that is available to ``handle`` and wait for the last."""
    writer = stream.writeStream.foreachBatch(handle).outputMode(mode)
    with stream_settings(stream.sparkSession):
        query = writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
