"""Sessions, and tables in the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "sluice", **conf: str) -> SparkSession:
    """A session with the settings that the operators are written for; whatever is already set stays."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only on one machine, in local mode, a temporary folder stands in where none is named; a cluster without one raises.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc._jsc.sc().getCheckpointDir()
    if not folder:
        if current.isDefined():
            folder = current.get()
        elif sc.master == "local" or sc.master.startswith("local["):
            folder = tempfile.mkdtemp(prefix="sluice-")
        else:
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not current.isDefined():
        sc.setCheckpointDir(folder)
    return folder


def _file_system(spark: SparkSession, path: str) -> tuple:
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(sc._jsc.hadoopConfiguration()), at


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: evaluated once, with no lineage behind it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sluice-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``written`` gave and that nothing will read any more."""
    for table in tables:
        if path := vars(table).pop("_written_to", None):
            files, at = _file_system(table.sparkSession, path)
            files.delete(at, True)


def shared_file(spark: SparkSession, name: str, data: bytes) -> str:
    """The path of a new file in the shared folder."""
    path = f"{shared_dir(spark)}/sluice-{uuid.uuid4().hex}/{name}"
    files, at = _file_system(spark, path)
    out = files.create(at)
    out.write(bytearray(data))
    out.close()
    return path


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are no longer referenced.

    Called after a phase whose result has been written: its shuffles are garbage, yet Spark's cleaner only
    sees that when the driver's JVM collects.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
