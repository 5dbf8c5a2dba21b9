"""Session defaults and the small helpers that every plan shares."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Tables that written has made in this process.
_WRITTEN: list[str] = []


def get_spark(app: str = "millrace", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and benches. On a cluster, bring your own session."""
    builder = (
        SparkSession.builder.master(f"local[{cpus or os.cpu_count() or 4}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df for a stage that works long on each row: a plain scan of fewer partitions than there are cores is
    dealt out to all of them. Larger inputs, and plans with shuffles of their own, stay as they are."""
    plan = df._jdf.queryExecution().executedPlan()
    cores = df.sparkSession.sparkContext.defaultParallelism
    if "Adaptive" in plan.nodeName() or "Exchange" in plan.toString():
        return df
    return df.repartition(cores) if plan.execute().getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: what the session names in spark.checkpoint.dir. Without one, a session on
    one machine (tests) gets a temporary folder; on a cluster that would lose data, so it is an error there."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        named = sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="millrace-")
        sc.setCheckpointDir(named)
    return named


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it again.

    Unlike localCheckpoint the result outlives any executor; unlike checkpoint() it is columnar and
    compressed, so later readers prune columns."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace/{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete what written has left in the shared folder, once no result is read any more; the number of tables.
    Works on any file system that Spark knows."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    gone = 0
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        gone += bool(path.getFileSystem(conf).delete(path, True))
    return gone
