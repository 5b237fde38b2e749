"""Shared folder, written tables and small helpers of the jobs here."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Partitions of a scan that one task of summed() takes, and tasks whose tables are added up at once.
SCANS_A_TASK, FAN_IN = 4, 64
#: Bytes of a materialised table up to which it may be broadcast.
BROADCAST_BYTES = 8 << 20
#: Bytes of an Arrow batch, and of a slice of texts, in the pipeline's stages: there executors and workers
#: live on from stage to stage and hold what earlier ones left, so a stage gets less room than a query of its own.
STAGE_BATCH, STAGE_SLICE = 6 << 20, 2_000_000
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir.  Where that is unset, a temporary folder, but on
    one machine only: executors elsewhere couldn't read it."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = _OWN.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="vellum-"))
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/vellum-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The table written as Parquet into the shared folder and read from there, which cuts its
    lineage: a lost executor loses nothing of it."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def size_of(df: DataFrame) -> int:
    """Bytes of the files that a table is read from; 0 if there are none."""
    spark = df.sparkSession
    total = 0
    for f in df.inputFiles():
        jpath = spark._jvm.org.apache.hadoop.fs.Path(f)
        total += jpath.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(jpath).getLen()
    return total


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hints a broadcast of a written() table if its files are small, else leaves the join to
    Spark, which shuffles both sides."""
    return F.broadcast(df) if size_of(df) <= limit else df


def arrow_batches(spark: SparkSession, size: int = 24 << 20) -> None:
    """Bounds the Arrow batches that Python workers get, by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def summed(df: DataFrame, columns: list[str], fill, shape: tuple[int, int], slice_rows: int = 1024):
    """The sum over all rows of tables of one fixed shape (float64).  ``fill(total, batch)`` adds a batch to
    a task's table.  A task takes a few partitions of the scan, so it doesn't grow with the input; tables travel in
    slices of rows and are added up in a tree, and what the driver gets is one table, whatever the input."""
    import numpy as np
    import pyarrow as pa

    from vellum.llm import text

    spark = df.sparkSession
    rows, width = shape
    kind = "slice bigint, sums binary"

    def partial(batches):
        total, some = np.zeros(shape), False
        for batch in batches:
            if batch.num_rows:
                some = True
                fill(total, batch)
        if some:
            cut = [total[i:i + slice_rows].tobytes() for i in range(0, rows, slice_rows)]
            yield pa.record_batch([pa.array(range(len(cut)), pa.int64()), pa.array(cut, pa.binary())], names=["slice", "sums"])

    def add(batches):
        sums: dict = {}
        for batch in batches:
            for k, raw in zip(batch.column("slice").to_pylist(), batch.column("sums").to_pylist()):
                v = np.frombuffer(raw)
                sums[k] = sums[k] + v if k in sums else v
        yield pa.record_batch([pa.array(list(sums), pa.int64()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["slice", "sums"])

    cores = max(2, spark.sparkContext.defaultParallelism)
    scan = df.select(*columns)
    tasks = max(2 * cores, -(-scan.rdd.getNumPartitions() // SCANS_A_TASK))
    parts = scan.coalesce(tasks).mapInArrow(text.tidy(partial), kind)
    slices = -(-rows // slice_rows)
    while tasks > FAN_IN:
        tasks = -(-tasks // FAN_IN)
        salted = parts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(tasks)))
        parts = salted.repartition(min(slices * tasks, 4 * cores), "slice", "salt").select("slice", "sums").mapInArrow(add, kind)
    parts = parts.repartition(min(slices, cores), "slice").mapInArrow(add, kind)
    out = np.zeros(shape)
    for r in parts.collect():
        at = r["slice"] * slice_rows
        got = np.frombuffer(r["sums"]).reshape(-1, width)
        out[at:at + len(got)] += got
    return out
