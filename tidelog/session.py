"""Session settings that the engine relies on, and the shared working folder of a session."""

from __future__ import annotations

import atexit
import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, app: str = "tidelog", memory: str = "8g", **conf: str) -> SparkSession:
    """A session on one machine, for tests and benchmarks; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a local folder serves sessions on one
    machine; on a cluster executors wouldn't see each other's files there, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is unset: it has to name a folder that the driver and all executors share")
        found = f"file:///tmp/tidelog-{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def _work_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/tidelog/{spark.sparkContext.applicationId}"


_registered: set[str] = set()


def _delete(spark: SparkSession, path: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cleanup(spark: SparkSession) -> None:
    """Delete the tables that this application has written between stages; frames read from them can't run again."""
    _delete(spark, _work_folder(spark))


def discard(*frames: DataFrame) -> None:
    """Delete tables that materialize() has written, after their last read; other frames are left alone."""
    for df in frames:
        path = getattr(df, "_work_path", None)
        if path:
            _delete(df.sparkSession, path)


def _at_exit(spark: SparkSession) -> None:
    if spark.sparkContext._jsc is not None:  # else the session has ended, and its driver with it
        cleanup(spark)


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, which goes when the driver's Python exits."""
    folder = _work_folder(spark)
    if folder not in _registered:
        _registered.add(folder)
        atexit.register(_at_exit, spark)
    return f"{folder}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._work_path = path
    return found
