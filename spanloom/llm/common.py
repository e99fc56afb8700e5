"""Shared helpers of the training-data operators: intermediate tables, paths, small checks."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import tempfile
import uuid

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MADE: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test-data table, read through Spark so that any store it can open will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares; a temporary one is set only in local mode, where the session names none."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not path:
        path = sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spanloom-")
        sc.setCheckpointDir(path)
    return path


def _remove_all() -> None:
    for path, spark in list(_MADE.items()):
        try:
            remove(spark, path)
        except Exception:  # the JVM may be gone at exit
            return


def remove(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table."""
    jvm, sc = spark._jvm, spark.sparkContext
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)
    _MADE.pop(path, None)


def materialize(df: DataFrame, tag: str, tidy: bool = False) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs only a reread.  Tables go when the session ends, or
    earlier through :func:`remove` (their path is the attribute ``spanloom_path``).  ``tidy`` has Spark's
    cleaner delete the shuffle files that only the written plan used, which it does at a collection only,
    and gives back what the driver no longer uses.
    """
    spark = df.sparkSession
    if not _MADE:
        atexit.register(_remove_all)
    path = f"{shared_dir(spark).rstrip('/')}/spanloom/{uuid.uuid4().hex}-{tag}"
    df.write.parquet(path)
    _MADE[path] = spark
    if tidy:
        release_driver(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out.spanloom_path = path
    return out


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't use yet, whatever its case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


def exactly(name: str) -> Column:
    """The column of just this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def release() -> None:
    """Give memory that a Python worker no longer uses back to the system; workers outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def release_driver(spark: SparkSession) -> bool:
    """Collect the driver's garbage and give its memory back to the system; whether the JVM has a command for its native part.

    Planning and compiling leave much free memory in the C allocator of the JVM, which a collection doesn't return.
    """
    release()
    spark._jvm.System.gc()
    jvm, new = spark._jvm, spark.sparkContext._gateway.new_array
    try:
        # by the interface: the server's own class is closed to py4j
        kinds = new(jvm.Class, 4)
        for i, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[i] = jvm.Class.forName(name)
        given = new(jvm.Object, 4)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke = jvm.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds)
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JError:  # another JVM, or one without the command
        return False
    return True


def single_threaded() -> None:
    """Have numpy's matrix products use one thread in this process: a worker is one of many, and small products only wait for more."""
    maps = "/proc/self/maps"
    if not os.path.exists(maps):
        return
    with open(maps) as f:
        paths = {line.split()[-1] for line in f if "openblas" in line}
    for path in paths:
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            limit = getattr(library, name, None)
            if limit:
                limit(1)
                break


def lean(run):
    """A batch function that takes batches of at most 1024 rows and releases its memory when it ends."""

    def small(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                yield b.slice(at, 1024)

    def wrapped(batches):
        yield from run(small(batches))
        release()

    return wrapped
