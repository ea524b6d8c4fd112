"""What the operators of this subpackage share: table access, durable
intermediate tables and joins that choose their strategy by a checked size."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space: the words of every operator here are runs of other characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: A side of at most so many rows is broadcast; beyond it the join is salted.
BROADCAST_ROWS = 20_000

#: Texts sent to a Python worker at once by ``small_batches``.
TEXT_ROWS = 500

#: Bytes of rows sent to a Python worker at once by the pipeline's stages, and the setting that says so.
BATCH_BYTES = 2 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table through Spark, so any store Spark reaches will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. A local one is made only where none is named
    and the master is local; on a cluster that would lose files, so it is an error."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="shared-")
    context.setCheckpointDir(own)
    return own


def cut(df: DataFrame) -> DataFrame:
    """End the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a wide or long intermediate as Parquet in the shared folder and
    read it back: it is smaller than a checkpoint, prunes columns, and survives
    the loss of any executor."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> Iterator[None]:
    """What is run while this is open sends so many rows to Python at once, at most.

    Spark's 10,000 rows of whole texts are tens of MB in buffers beside the heap and again in
    the worker, for each task. Only for what is run inside: a lazy table is sent as its reader says."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def bound_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """From now on the session sends so many bytes to Python at once, at most; a lower bound stays.

    For stages that return a lazy table, whose batches are cut when its reader runs it. Without
    this a batch of texts is a whole partition: its buffers lie beside the heap, on both sides."""
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH_SETTING))
    if not 0 < now <= most:
        spark.conf.set(BATCH_SETTING, str(most))


def give_back() -> None:
    """Return to the system what this process has freed and its allocators still hold."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def tidy(run: Callable) -> Callable:
    """A function for ``mapInArrow`` that gives memory back before and after its task: workers are kept for later tasks."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        yield from run(batches)
        give_back()

    return tidied


def discard(df: DataFrame) -> None:
    """Delete a table made by ``stored``; only for tables that nothing reads any more."""
    spark = df.sparkSession
    inside = shared_dir(spark).split(":", 1)[-1].lstrip("/")
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if folder.split(":", 1)[-1].lstrip("/").startswith(inside + "/"):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release_spent(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files and checkpoints that no table refers to any more, and give the driver's memory back.

    It learns of them from the garbage collection of the driver, which may be long in coming. That
    bounds the heap; what the compiler and the buffers beside it have freed is returned by ``trim_jvm``."""
    gc.collect()
    spark._jvm.System.gc()
    trim_jvm(spark)
    give_back()


def trim_jvm(spark: SparkSession) -> bool:
    """Return to the system what the driver's JVM has freed beside its heap; false where the JVM has no such command."""
    jvm, array = spark._jvm, spark._sc._gateway.new_array
    try:
        name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        # by reflection on the interface: the server's own class is not open to py4j
        kind = jvm.java.lang.Class.forName("javax.management.MBeanServer")
        call = next(m for m in kind.getMethods() if m.getName() == "invoke")
        given = array(jvm.Object, 4)
        given[0], given[1], given[2], given[3] = name, "systemTrimNativeHeap", array(jvm.Object, 0), array(jvm.String, 0)
        call.invoke(server, given)
    except (Py4JError, StopIteration):  # not a HotSpot of 17.0.9 or later on glibc
        return False
    return True


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or it with underscores where ``df`` has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def with_place(df: DataFrame, name: str) -> DataFrame:
    """Add a long that tells the rows of a table of files apart, and is the same at every
    reading: the number of the row's file, times 2 ** 40, plus its place in the file.

    A table that does not come from files as it is gets stored first."""
    try:
        files = cut(df.select(F.col("_metadata.file_path").alias("_path")).distinct())
        df.select("_metadata.row_index").schema
    except AnalysisException:
        return with_place(stored(df, "rows"), name)
    path, at = free_name(df, "_path"), free_name(df, f"{name}_at")
    order = Window.orderBy("_path")  # a row for each file
    numbered = cut(files.select(F.col("_path").alias(path), ((F.row_number().over(order) - 1).cast("long") * F.lit(1 << 40)).alias(name)))
    rows = df.select("*", F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(at))
    few = numbered.count() <= BROADCAST_ROWS
    joined = rows.join(F.broadcast(numbered) if few else numbered, path)
    return joined.select(*df.columns, (F.col(name) + F.col(at)).alias(name))


def attach(left: DataFrame, small: DataFrame, keys: list[str], rows: int = BROADCAST_ROWS, salts: int = 32) -> DataFrame:
    """Left join of a small aggregate, unique in ``keys`` (nulls match nulls).

    ``small`` must be cheap to count (a checkpoint). Up to ``rows`` rows it is
    broadcast. Beyond that both sides are dealt by the keys and a salt, so that
    a key with a third of the left rows is spread over ``salts`` tasks."""
    renamed = small.select(*(F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in small.columns))
    on = [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys]
    drop = [f"_r_{k}" for k in keys]
    if small.limit(rows + 1).count() <= rows:
        condition = on[0]
        for c in on[1:]:
            condition = condition & c
        return left.join(F.broadcast(renamed), condition, "left").drop(*drop)
    salted = left.withColumn("_salt", (F.rand(7) * salts).cast("int"))
    many = renamed.withColumn("_salt_r", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    condition = salted["_salt"] == many["_salt_r"]
    for k in keys:
        condition = condition & salted[k].eqNullSafe(many[f"_r_{k}"])
    return salted.join(many, condition, "left").drop("_salt", "_salt_r", *drop)
