"""Session defaults and the helpers that need a session: staging and spreading."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "millrace", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the operators are tested with.

    On a cluster pass your own session instead; no operator reads these settings.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder for staged tables: ``spark.checkpoint.dir``, which every node must see.

    Only a local session may go without it; it then gets a temporary folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all nodes")
    made = tempfile.mkdtemp(prefix="millrace-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return os.path.join(shared_dir(spark), "millrace", f"{label}-{uuid.uuid4().hex}")


_STAGED: list[str] = []


def _delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Delete what :func:`stage` has written in this process. Frames that read it can no longer be used."""
    while _STAGED:
        _delete(spark, _STAGED.pop())


def free(spark: SparkSession) -> None:
    """Delete the shuffle files of finished jobs.

    Spark deletes a shuffle's files when the driver's garbage collection finds that no plan refers to it; on a
    driver with a large heap that may be long after the job.
    """
    gc.collect()
    spark._jvm.System.gc()


def unstage(*staged: DataFrame) -> None:
    """Delete tables that :func:`stage` has written, once nothing will read them again, and the shuffle files of finished jobs."""
    for df in staged:
        _delete(df.sparkSession, df.staged_path)
        _STAGED.remove(df.staged_path)
    if staged:
        free(staged[0].sparkSession)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    For results that several branches use: the lineage ends at files that survive the loss of
    executors, and each reader prunes columns as on any parquet table. :func:`release` deletes the files, :func:`unstage` those of
    one table.
    """
    path = new_path(df.sparkSession, label)
    _STAGED.append(path)
    df.write.parquet(path)
    staged = df.sparkSession.read.schema(df.schema).parquet(path)
    staged.staged_path = path
    return staged


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """Give CPU-heavy work enough tasks when a scan yields few partitions.

    One small file is one task however costly the expressions on it are. At scale a scan has more
    splits than the cluster has cores, and is returned as it is, without a shuffle. Call it on
    plain scans only: asking for the partition count plans the frame.
    """
    wanted = 2 * scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= wanted // 2:
        return scan
    return scan.repartition(wanted, *keys)


def partition_by(df: DataFrame, *keys: str, tasks: int | None = None) -> DataFrame:
    """Hash-partition by ``keys`` into ``tasks`` tasks, by default ``spark.sql.shuffle.partitions``, and keep them all.

    For short rows that are about to grow, such as texts before shingling: adaptive execution sizes
    partitions by the bytes it sees now and would put megabytes of text, then gigabytes of
    shingles, into one task. Grouping by the same keys afterwards needs no further shuffle.
    """
    return df.repartition(tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
