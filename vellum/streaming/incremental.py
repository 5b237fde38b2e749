"""New and changed documents as they arrive.

Each micro-batch is compressed by single-document rules (rules of the corpus would need what is yet to come)
and appended; what the manifest already has in the same state is left out first.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vellum.operators.registry import Options
from vellum.plans import pipeline, stats, store
from vellum.sources.markdown import read_manifest


def compress_stream(spark: SparkSession, source: str, out: str, manifest: str, checkpoint: str, options: Options = Options(), schema: str = "path string, text string") -> StreamingQuery:
    """Parquet files of documents that appear in ``source`` are compressed into ``out`` once."""
    docs = spark.readStream.schema(schema).parquet(source)
    off = tuple(r.name for r in options.rules() if r.apply is None)
    single = Options(options.tier, options.enabled, (*options.disabled, *off), options.max_lines, options.compat, False, options.plugins)

    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def batch(df: DataFrame, number: int) -> None:
        # A batch that ran before but wasn't committed is repeated: it ignores its own rows in the manifest, and replaces its files.
        own = f"batch=s{stream}-{number}"
        known = read_manifest(spark, manifest)
        if "batch" in known.columns:
            known = known.where(F.col("batch").isNull() | (F.col("batch") != own.removeprefix("batch=")))
        fresh = store.written(stats.pending(df, known).dropDuplicates(["path", "text"]), "stream")
        results = store.written(pipeline.compress(fresh, single), "stream-results")
        results.write.mode("overwrite").parquet(f"{out}/{own}")
        stats.manifest_of(results).select("source", "sha256", "tokens_before", "tokens_after").write.mode("overwrite").parquet(f"{manifest}/{own}")

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
