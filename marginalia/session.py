"""Session and durability helpers shared by every operator."""

from __future__ import annotations

import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", name: str = "marginalia", shared: str | None = None) -> SparkSession:
    """A session for tests and benches, with ``shared`` as its shared folder; on a cluster the caller brings their own."""
    cores = 8 if cpus == "*" else int(cpus)
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.streaming.forceDeleteTempCheckpointLocation", "true")
    )
    spark = (builder.config("spark.checkpoint.dir", shared) if shared else builder).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The reliable folder the cluster names in ``spark.checkpoint.dir``, else one in the warehouse, which is shared too.

    A cluster that names none is told so, as its warehouse may be a folder of the driver alone.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        warnings.warn("spark.checkpoint.dir is unset: intermediate tables go to the warehouse, which all executors must reach", stacklevel=2)
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to reliable storage and cut its lineage.

    Lost executors then cost a re-read, and a partition keeps its rows however often it is read.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Like ``durable``, as a compressed table of columns: a fraction of the bytes for wide rows, and later steps read
    only the columns they use.  It stays until the folder is cleared."""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
