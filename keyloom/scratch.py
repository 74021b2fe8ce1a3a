"""A folder that driver and executors share, for tables that a query writes on its way.

Everything lies below ``spark.checkpoint.dir``, in a folder of the application,
which goes when the application ends; ``release`` deletes earlier what is no
longer read.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterable
from contextlib import suppress
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


@dataclass
class _Scratch:
    """What a session has written: its folder and the paths in it, in the order of their making."""

    folder: str
    paths: list[str] = field(default_factory=list)


def _java_path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _scratch(spark: SparkSession) -> _Scratch:
    base = (spark.conf.get("spark.checkpoint.dir", "") or "").rstrip("/")
    known = getattr(spark, "_keyloom_scratch", None)
    if known is not None and (not base or known.folder.startswith(f"{base}/")):
        return known
    if not base:
        # a single process may do without the setting
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="keyloom-")
    made = _Scratch(f"{base}/keyloom-{spark.sparkContext.applicationId}-{uuid.uuid4().hex[:8]}")
    where, fs = _java_path(spark, made.folder)
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    spark._keyloom_scratch = made
    return made


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's folder."""
    own = _scratch(spark)
    own.paths.append(f"{own.folder}/{name}-{uuid.uuid4().hex}")
    return own.paths[-1]


def materialize(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a reader of it.

    This cuts the lineage in a way that survives lost executors: the files are
    in the shared folder, not on an executor's disk.
    """
    path = scratch_path(spark, name)
    df.write.parquet(path)
    give_back(spark)
    table = spark.read.schema(df.schema).parquet(path)
    table._keyloom_path = path
    return table


def mark(spark: SparkSession) -> int:
    """How many paths there are by now; see ``release``."""
    return len(_scratch(spark).paths)


def release(spark: SparkSession, since: int, keep: Iterable[DataFrame] = (), until: int | None = None) -> None:
    """Delete what was made after the mark ``since`` (and before ``until``), but for the tables to ``keep``."""
    own = _scratch(spark)
    tail = own.paths[since:until]
    stay = {df._keyloom_path for df in keep}
    for path in tail:
        if path not in stay:
            where, fs = _java_path(spark, path)
            fs.delete(where, True)
    own.paths[since : since + len(tail)] = [p for p in tail if p in stay]


def discard(spark: SparkSession, table: DataFrame) -> None:
    """Delete a table that ``materialize`` returned."""
    own = _scratch(spark)
    where, fs = _java_path(spark, table._keyloom_path)
    fs.delete(where, True)
    own.paths.remove(table._keyloom_path)


def give_back(spark: SparkSession) -> None:
    """Return the memory that the driver has freed to the system.

    Plans of many joins run in hundreds of short-lived threads, whose freed
    native memory the C library keeps otherwise: about 200 MB after some minutes.
    """
    _trim_java(spark)
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def _trim_java(spark: SparkSession) -> None:
    """Run the diagnostic command that trims the native heap; absent on other systems than Linux, and on older Java."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()

    def array(kind, *items):
        out = gateway.new_array(kind, len(items))
        for k, item in enumerate(items):
            out[k] = item
        return out

    # the server's own class is hidden: its methods are reached through the interface
    name_of, types = jvm.java.lang.Class.forName, (jvm.java.lang.Class, jvm.Object)
    kind = name_of("javax.management.ObjectName")
    names, command = array(jvm.String), jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    invoke = name_of("javax.management.MBeanServer").getMethod("invoke", array(types[0], kind, name_of("java.lang.String"), array(jvm.Object).getClass(), names.getClass()))
    with suppress(Py4JJavaError):
        invoke.invoke(server, array(types[1], command, "systemTrimNativeHeap", array(jvm.Object), names))
