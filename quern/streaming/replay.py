"""Streams over folders of files, run to their end.

Each query reads what a folder holds as a stream, keeps its state in the
state store under a checkpoint in the shared folder, and writes micro-batches
with foreachBatch, so a lost executor replays from the checkpoint.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.plans.checkpoints import ensure_dir
from quern.sources.tables import table, with_timestamps


#: Files of one micro-batch, at most.
FILES_PER_BATCH = 64


def read(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """A table's files as a stream, with its batch schema; zone-less timestamps as TIMESTAMP."""
    schema = table(spark, sf_dir, name).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    one = f"{sf_dir}/{name}.parquet"
    whole = spark._jvm.org.apache.hadoop.fs.Path(one)
    is_folder = whole.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(whole).isDirectory()
    stream = reader.parquet(one) if is_folder else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return with_timestamps(stream)


def run(stream: DataFrame, mode: str, each: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Run a stream over all that is there; the rows it emitted, with the number of their batch."""
    spark = stream.sparkSession
    ensure_dir(spark)
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        out = each(batch) if each else batch
        # Overwriting a batch's own folder makes a repeated batch harmless.
        out.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{base}/out/{number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.parquet(f"{base}/out/*")


def last_of(rows: DataFrame, key: list[str]) -> DataFrame:
    """Of rows emitted in update mode the last per key."""
    rest = [c for c in rows.columns if c not in key and c != "batch"]
    return rows.groupBy(*key).agg(F.max(F.struct("batch", *rest)).alias("r")).select(*key, *[F.col(f"r.{c}").alias(c) for c in rest])
