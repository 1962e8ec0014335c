"""Session settings and the shared folder that cuts of lineage use."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Settings that the operators rely on; sizes of shuffles stay with AQE and the cluster.
CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",  # cuts of lineage are deleted when nothing refers to them
}


def build(master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with CONF; keyword names have _ for dots."""
    b = SparkSession.builder.master(master).config(map=CONF)
    for k, v in conf.items():
        b = b.config(k.replace("_", "."), v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the given folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def estimated_bytes(df: DataFrame) -> int:
    """What the optimizer expects df to hold; far too much where it can't tell."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if it is expected to stay below the session's broadcast threshold; otherwise Spark joins it as it sees fit."""
    from pyspark.sql import functions as F

    most = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return F.broadcast(df) if estimated_bytes(df) <= most else df


def spread(df: DataFrame, *keys: str, most: int = 16 << 20) -> DataFrame:
    """df over all cores by keys if it is a table of at most `most` bytes in fewer files than there are cores, which few tasks would read; other tables are left as they are read."""
    cores = max(2, df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(cores, *keys) if estimated_bytes(df) <= most and len(df.inputFiles()) < cores else df


def _path(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on any file system the session knows."""
    fs, p = _path(spark, path)
    return bool(fs.exists(p))


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder with what is in it."""
    fs, p = _path(spark, path)
    fs.delete(p, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder, with its lineage cut.

    The folder is spark.checkpoint.dir of the session; only where that is unset, as in
    tests on one machine, a temporary folder is taken.
    """
    spark = df.sparkSession
    jsc = spark.sparkContext._jsc.sc()
    if not jsc.getCheckpointDir().isDefined():
        where = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not where:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            where = tempfile.mkdtemp(prefix=f"vellum-{os.getpid()}-")
        spark.sparkContext.setCheckpointDir(where)
    return df.checkpoint(eager=True)
