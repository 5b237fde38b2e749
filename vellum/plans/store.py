"""Tables written into the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_BYTES = 8 << 20
_OWN: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (at or _OWN.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="vellum-"))).rstrip("/")


def arrow_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches that Python workers get, by rows and by bytes: by default a batch has 10,000 texts of any size."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def written(df: DataFrame, name: str) -> DataFrame:
    """Written and reread: cuts the lineage, and survives lost executors."""
    path = f"{folder(df.sparkSession)}/md-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """For written tables: a broadcast hint if the files are small, else none."""
    spark, total = df.sparkSession, 0
    for f in df.inputFiles():
        p = spark._jvm.org.apache.hadoop.fs.Path(f)
        total += p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).getLen()
    return F.broadcast(df) if total <= limit else df


def spread(df: DataFrame, per_core: int = 32 << 20) -> DataFrame:
    """A table read from few bytes of files is dealt to all cores: its files may have fewer row groups than there are
    cores.  A table of over ``per_core`` bytes a core has enough of them, and isn't shuffled."""
    spark, total = df.sparkSession, 0
    cores = spark.sparkContext.defaultParallelism
    for f in df.inputFiles():
        p = spark._jvm.org.apache.hadoop.fs.Path(f)
        total += p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).getLen()
        if total > per_core * cores:
            return df
    return df.repartition(2 * cores)
