"""Session helpers: a local session for tests and benches, table paths, and shared working tables."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app: str = "lectern", partitions: int = 8, memory: str = "6g") -> SparkSession:
    """A local session with UTC time, adaptive execution and a few shuffle partitions."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, task_rows: int = 1 << 13) -> DataFrame:
    """df over so many tasks that each takes about task_rows of its rows, for steps that make much of each row.

    A small file holds many rows, which its reader leaves in one task. df is counted for that, so it should be a table.
    """
    return df.repartition(max(1, -(-df.count() // task_rows)))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the session's spark.checkpoint.dir.

    Only a session on one machine that names none (as in tests) gets a folder of its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that the driver and all executors of {master} share")
        path = "file://" + tempfile.mkdtemp(prefix="lectern-", dir=os.environ.get("LECTERN_TMP", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", path)
    return path


#: Rows of a task that only joins or sums up short rows.
TASK_ROWS = 1 << 14


def keep(df: DataFrame, name: str = "t", rows: int | None = None, task_rows: int = TASK_ROWS) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it back.

    Unlike a block kept on executors, the written table survives their loss, and unlike
    checkpoint() the plan runs once and later readers prune columns.

    rows: at most so many go through the last step, if that is known. It then takes no more tasks
    (and files) than one for each task_rows of them, however many the session's shuffles make.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // task_rows)))
    path = f"{shared_dir(spark)}/lectern-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keep_by(df: DataFrame, name: str, key: str) -> DataFrame:
    """As keep(), but in buckets by a column, one for each partition of a shuffle: joins by that column don't shuffle df again.

    Only a catalog takes buckets, so it's a table of the current database for a moment. That it is dropped there
    leaves its files, and the DataFrame knows its buckets.
    """
    spark, own = df.sparkSession, uuid.uuid4().hex
    path, entry = f"{shared_dir(spark)}/lectern-{name}-{own}", f"lectern_{name}_{own}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").option("path", path).bucketBy(n, key).saveAsTable(entry)
    kept = spark.table(entry)
    spark.sql(f"DROP TABLE {entry}")
    return kept


def drop_kept(df: DataFrame) -> None:
    """Delete the files of a table that keep() wrote and nothing reads any more."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if "/lectern-" in folder:
            path.getFileSystem(conf).delete(path, True)
