"""What the operators share: code shipping, the shared folder, and materialising tables."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_SHIPPED: set[str] = set()
#: Folders of intermediates that have not been discarded.
_MADE: list[str] = []


def ship(spark: SparkSession) -> None:
    """Send this package's sources to the executors, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="lenticule_"), "lenticule_src.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Only where the session names none and everything runs in one process (tests) is a temporary folder set.
    """
    conf = spark.sparkContext.getConf()
    folder = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that the driver and all executors of {master} see")
        folder = "file://" + tempfile.mkdtemp(prefix="lenticule_shared_")
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has used."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete intermediates that nothing reads any more."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        if path in _MADE:
            _MADE.remove(path)


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """Delete, at the end, whatever operators have put into the shared folder meanwhile. Their results must be written by then."""
    before = set(_MADE)
    try:
        yield
    finally:
        discard(spark, *(p for p in list(_MADE) if p not in before))


#: A hash aggregate's first, smaller map takes a whole page of memory (32 MB at 900 MB for two cores) for each task, however few its rows are.
ONE_MAP = {"spark.sql.codegen.aggregate.map.twolevel.enabled": "false"}


def give_back(spark: SparkSession) -> None:
    """Have the executors collect their garbage: a JVM keeps the heap that its busiest stage took until a full collection finds it free.

    One task for each core, so that idle executors all get some; one that gets none keeps its heap, and no result depends on it.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc")).alias("done")).write.format("noop").mode("overwrite").save()


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    for name, value in ONE_MAP.items():
        spark.conf.set(name, value)
    path = fresh_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.path = path
    return out


#: Batches of whole texts are bounded by bytes; a session that asks for less keeps its own bound.
BATCH_BYTES = 1 << 20


#: What a worker process keeps from task to task, by name.
_HELD: dict[str, object] = {}


def held(name: str, make: Callable[[], object]) -> object:
    """What this worker process keeps under ``name``, made on first use."""
    if name not in _HELD:
        _HELD[name] = make()
    return _HELD[name]


def let_go(but: str | None) -> None:
    """Forget what the worker keeps under other names."""
    others = [name for name in _HELD if name != but]
    for name in others:
        del _HELD[name]
    if others:
        gc.collect()  # what refers to itself


def map_rows(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType, holds: str | None = None) -> DataFrame:
    """``mapInArrow`` with the package's sources at hand on the executors, in batches of bounded size.

    Workers are used again, so each task gives the memory that it has freed back to the system, and forgets what earlier tasks keep
    unless it is what this one ``holds``.
    """
    spark = df.sparkSession
    ship(spark)
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(bound).removesuffix("b")) <= BATCH_BYTES:
        spark.conf.set(bound, str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(holds)
        try:
            yield from fn(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # other systems than Linux
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return df.mapInArrow(run, schema)


#: Bits of the filter of ``maybe_among``: 2,048 rows of 4,096 bytes at most, whatever the tables' sizes.
FILTER_BITS, FILTER_ROW = 1 << 26, 1 << 15


def maybe_among(df: DataFrame, on: Column, ids: DataFrame, flag: str) -> DataFrame:
    """``df`` with ``flag``: whether ``on`` may be one of ``ids`` (one column). No shuffle: a hashed bitmap of fixed size is broadcast.

    It is true for all that are among them; the more there are, the more often for others too.
    """
    names = [F.col(f"`{c}`") for c in df.columns]
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    bits = ids.select(place(F.col(ids.columns[0])).alias("at"))
    rows = bits.groupBy((F.col("at") / FILTER_ROW).cast("int").alias("__row")).agg(F.bitmap_construct_agg(F.col("at") % FILTER_ROW).alias("__bits"))
    met = df.withColumn("__at", place(on)).withColumn("__in", (F.col("__at") / FILTER_ROW).cast("int"))
    met = met.join(F.broadcast(rows), F.col("__in") == F.col("__row"), "left")
    at = (F.col("__at") % FILTER_ROW).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("__bits"), F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return met.select(*names, F.coalesce(F.call_function("shiftright", byte, at % 8).bitwiseAND(F.lit(1)) == 1, F.lit(False)).alias(flag))


#: Ids are broadcast up to so many of them and bytes of them; beyond that both sides are dealt out by the id.
MOST_IDS, MOST_ID_BYTES = 1 << 19, 8 << 20


def _by_ids(df: DataFrame, on: Column, ids: DataFrame, how: str) -> DataFrame:
    ids = ids.toDF("__id")
    n, size = ids.agg(F.count("*"), F.sum(F.octet_length(F.col("__id").cast("string")))).first()
    side = F.broadcast(ids) if n <= MOST_IDS and (size or 0) <= MOST_ID_BYTES else ids
    return df.join(side, on.eqNullSafe(side["__id"]), how)


def only(df: DataFrame, on: str | Column, ids: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``on`` is one of ``ids`` (one column; cheap to read twice). Few ids cost no shuffle."""
    return _by_ids(df, df[on] if isinstance(on, str) else on, ids, "left_semi")


def without(df: DataFrame, on: str | Column, ids: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``on`` is none of ``ids``."""
    return _by_ids(df, df[on] if isinstance(on, str) else on, ids, "left_anti")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
