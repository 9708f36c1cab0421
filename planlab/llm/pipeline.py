"""Where a pipeline's stages are written: the shared folder of the session."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame

from planlab.session import checkpointed


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write a stage as Parquet below ``spark.checkpoint.dir`` and read it again."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        checkpointed(spark.range(1))  # sets the folder the session names
    path = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}/{name}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.parquet(path)


def dropped(*frames: DataFrame) -> None:
    """Delete what ``written`` wrote for these frames, and let Spark drop the shuffle files that nothing refers to any more.

    For loops that write in every round: only what no later step reads may be dropped.
    """
    for df in frames:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    if frames:
        frames[0].sparkSession.sparkContext._jvm.System.gc()
