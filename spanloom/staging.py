"""Intermediate tables: a result that several branches use is written once and read again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset, a temporary one in local mode, else an error."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spanloom-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        sc.setCheckpointDir(path)
    return path


def _remove() -> None:
    for spark, path in _MADE:
        try:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the JVM may be gone at exit
            return


def staged(df: DataFrame, tag: str) -> DataFrame:
    """``df``, written to the shared folder and read back; tables go when the session ends."""
    spark = df.sparkSession
    if not _MADE:
        atexit.register(_remove)
    path = f"{shared_folder(spark).rstrip('/')}/spanloom/{uuid.uuid4().hex}-{tag}"
    df.write.parquet(path)
    _MADE.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)
