"""Where intermediate tables go: the folder that all executors share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


BATCH_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; one of our own only where none is set, as in tests."""
    context = spark.sparkContext
    folder = context.getCheckpointDir()
    if folder:
        return folder
    context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def small_batches(spark: SparkSession) -> None:
    """Lets Arrow pass texts on in batches of at most BATCH_BYTES (or of one longer row).

    What executors and workers hold of texts then doesn't depend on how long they
    are.  Spark reads the setting when a plan runs, which for what an operator
    returns is after the operator; so every operator that reads texts sets it,
    whichever ran before, and it stays.  A lower bound of the user's own is kept.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.conf.get(name)
    if not (own.isdigit() and 0 < int(own) < BATCH_BYTES):
        spark.conf.set(name, str(BATCH_BYTES))


def whole_row(docs: DataFrame) -> Column:
    """All columns of docs as one value, so that no name of theirs can clash with another's."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a compressed table in the shared folder, and its path, for `remove` when it is out of use."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path), path


def release(spark: SparkSession) -> None:
    """Lets Spark remove the files of shuffles and checkpoints that are out of use, now rather than at some later time."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    trim_driver(spark)


def trim_driver(spark: SparkSession) -> bool:
    """Lets the driver's JVM return to the system what its C library holds of freed memory; False if this JVM has no such command.

    Compilers and hundreds of threads allocate there, outside of the heap, and
    without this the library keeps the most that each of them ever had.
    """
    jvm = spark.sparkContext._jvm
    try:
        kind = jvm.java.lang.Class.forName("javax.management.MBeanServer")
        invoke = next(m for m in kind.getMethods() if m.getName() == "invoke")
        given = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JError:  # before Java 17.0.9, or not the GNU C library
        return False
    return True


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def trim() -> None:
    """Returns what the C library holds of freed memory to the system."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU C library
        pass


#: The C library's names of two settings, and values in bytes: an array of its own mapping, free memory that goes back.
MMAP_THRESHOLD, TRIM_THRESHOLD = -3, -1
MAPPED, HELD, USUAL = 32 << 20, 128 << 20, 64 << 20


def keep_freed(held: int = HELD) -> None:
    """Lets the C library use freed memory again, up to so much, rather than ask the system for each array.

    `give_back` returns it; USUAL is what the library itself comes to with arrays of MAPPED bytes.
    """
    try:
        library = ctypes.CDLL(None)
        library.mallopt(MMAP_THRESHOLD, MAPPED)
        library.mallopt(TRIM_THRESHOLD, held)
    except (AttributeError, OSError):  # not the GNU C library
        pass


def give_back() -> None:
    """Returns freed memory to the system: workers live on after a task, and what they hold counts for the executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim()


def settle(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and cuts its lineage there.

    What earlier rounds have shuffled is then out of use; collecting the driver's
    garbage lets Spark remove those files now rather than at some later time.
    """
    shared_folder(df.sparkSession)
    out = df.checkpoint()
    release(df.sparkSession)
    return out
