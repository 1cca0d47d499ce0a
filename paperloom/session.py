"""Session settings and table loaders."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()

#: Whether a query's shuffle files go when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for local use; on a cluster the submitter's settings win."""
    return (
        SparkSession.builder.master(master)
        .appName("paperloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of TABLES under sf_dir, read by Spark alone (any Hadoop path works)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, or the checkpoint folder set before.

    Where neither is set, a local master gets a temporary folder; a cluster raises, as its
    executors do not share a machine's own folders.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    jsc = spark.sparkContext._jsc.sc()
    if not path and jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get()
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="paperloom-")
    if not jsc.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(path)
    return path


def keep(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, which outlives lost executors.

    What was shuffled for it is read no more then, and its files go at once, not when the driver collects its garbage.
    """
    shared_dir(df.sparkSession)
    conf = df.sparkSession.conf
    before = conf.get(SHUFFLE_CLEANUP, None)
    conf.set(SHUFFLE_CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a query of its own, as the setting counts from where one is made
    finally:
        conf.unset(SHUFFLE_CLEANUP) if before is None else conf.set(SHUFFLE_CLEANUP, before)


def spread(df: DataFrame) -> DataFrame:
    """df's rows dealt out evenly over eight tasks for each that runs at once, for costly work on each row.

    A table's file may hold all its rows in one row group, which is one task however many splits it has.
    """
    return df.repartition(8 * df.sparkSession.sparkContext.defaultParallelism)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of any Hadoop file system, if it is there."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
