"""Lineage cuts that survive the loss of executors."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; only a session without one (tests) gets its own."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if shared is None and master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp(prefix="quern-ckpt-"))


def shared_dir(spark: SparkSession) -> str:
    """The folder of this session's checkpoints, as a URI that all executors can read."""
    ensure_dir(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the checkpoint folder and read on from there."""
    ensure_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(df: DataFrame) -> None:
    """Delete the files of a frame that cut gave and nothing reads any more, as in the rounds of a loop."""
    spark = df.sparkSession
    plan = df._jdf.queryExecution().analyzed()
    if plan.nodeName() != "LogicalRDD" and not plan.getClass().getSimpleName().startswith("LogicalRDD"):
        return
    file = plan.rdd().getCheckpointFile()
    if file.isDefined():
        path = spark._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
