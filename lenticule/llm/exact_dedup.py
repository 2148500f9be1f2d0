"""Exact deduplication with streaming state on disk.

A stream of headers (digest, stable identifier, content locator) is grouped by digest. The state store is RocksDB, has no
expiry, and keeps for each digest the row that stays, its locator and a count; the stream is partially aggregated before it is
dealt out, so a digest that very many rows share is no hot spot. With a ``state`` folder the state outlives the run: each delivery
of rows is then judged against all deliveries before it, whose files must still be there.

A hit in the state is confirmed on the whole bytes: rows of a digest that occurs more than once meet the text of the row that stays,
which is fetched by its locator where an earlier delivery holds it. Digests of very many rows are salted for that. Should texts differ
under one digest, the rows of the delivery that have it are grouped again by their texts.

The locator of a row is its file and its position there, from Spark's file metadata; rows of any other origin, and tables with a column
named ``_metadata``, are written to the shared folder first, which gives them one.

Texts are equal when identical after lower-casing A-Z. The row with the largest key stays; of rows that share it, the one with the
largest locator, so exactly one. Null text counts as empty. A null key is smaller than any other. An empty table gives an empty
result. Texts of any length are compared whole. Other columns do not matter, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ONE_MAP, fresh_path, materialise, without

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# allowFAllocate off: with it, every state partition sets aside some megabytes of disk for its logs; small write buffers, for a
# partition's first block of memory is an eighth of one; a partition's store is closed when its task ends, so an executor holds as many
# as it has cores and not its share of all, and none once the run is over
STORE = {
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
# for a local folder, Spark's other manager starts some processes (readlink and the like) for each file of the state; each shares its
# executor's memory until it runs, and whoever adds up processes counts that twice. A local rename replaces as a whole with both
LOCAL_STORE = {"spark.sql.streaming.checkpointFileManagerClass": "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager"}


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _free(columns: list[str], name: str) -> str:
    """``name``, with as many underscores as make it new."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def locatable(df: DataFrame) -> DataFrame:
    """``df`` itself if Spark's file metadata tells its rows apart; else a copy that does, with columns named __c0, __c1, ..."""
    names = [f"__c{i}" for i in range(len(df.columns))]
    if "_metadata" not in {c.lower() for c in df.columns}:
        try:
            df.select("_metadata.file_path", "_metadata.row_index")
            return df
        except AnalysisException:
            pass
    return materialise(df.toDF(*names), "dedup_input")


def _place() -> list[Column]:
    return [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]


def dedup_state(headers: DataFrame, keep: str) -> DataFrame:
    """The streaming aggregate itself, over a stream (or a table) of digest and ``keep``: what stays, and how many there are."""
    return headers.groupBy("digest").agg(F.max(keep).alias("stays"), F.count("*").alias("n"))


def _run_stream(headers: DataFrame, base: str) -> DataFrame:
    """Run all headers under ``base`` that it has not seen through the state; the latest value of each digest."""
    spark = headers.sparkSession
    own = spark.newSession()
    for k, v in {**STORE, **(LOCAL_STORE if base.startswith("file:") else {}), **ONE_MAP, "spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions")}.items():
        own.conf.set(k, v)
    out = f"{base}/groups"
    stream = dedup_state(own.readStream.schema(headers.schema).parquet(f"{base}/headers/*"), "keep")
    shape = stream.schema
    own.createDataFrame([], shape).write.mode("overwrite").parquet(f"{out}/batch=-1")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    # values only grow, so the largest is the latest, and a batch that ran twice does no harm
    return spark.read.schema(shape).parquet(f"{out}/batch=*").groupBy("digest").agg(F.max("stays").alias("stays"), F.max("n").alias("n"))


def _exists(df: DataFrame, path: str) -> bool:
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _earlier_texts(wanted: DataFrame, text: str) -> DataFrame:
    """(digest, __norm) of rows that stay and are in files of earlier deliveries, read by their locators."""
    spark = wanted.sparkSession
    files = [r[0] for r in wanted.select("stays.file").distinct().collect()]  # files, not documents
    # a file of the caller's, or one that locatable() wrote; a column that a file lacks is null
    read = spark.read.schema(f"`{text}` string, __c1 string").parquet(*files)
    found = read.select(normalised(F.coalesce(F.col(f"`{text}`"), F.col("__c1"))).alias("__norm"), *_place())
    return found.join(wanted, (F.col("file") == F.col("stays.file")) & (F.col("row") == F.col("stays.row"))).select("digest", "__norm")


def exact_duplicates(
    df: DataFrame, key: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256, state: str | None = None, delivery: str | None = None, split: int = 100_000
) -> DataFrame:
    """One row for each row of ``df``: the key, place (file and row), keep_id, group_size, kept and text_sha256.

    ``state`` is a folder that holds the state between calls, and ``delivery`` names the rows of this call: a call that is repeated with the
    same name counts them once. Digests of more than ``split`` rows are salted.
    """
    spark = df.sparkSession
    located = locatable(df.select(key, text))
    names = located.columns
    source = located.select(F.col(names[0]).alias("__key"), normalised(F.col(names[1])).alias("__norm"), F.struct(F.col(names[0]).alias("key"), *_place()).alias("keep"))
    base = state.rstrip("/") if state else fresh_path(spark, "dedup")
    path = f"{base}/headers/d-{delivery or uuid.uuid4().hex}"
    same = digest is sha256
    headers = source.select(digest(F.col("__norm")).alias("digest"), "keep", *([] if same else [sha256(F.col("__norm")).alias("sha")]))
    if not _exists(df, f"{path}/_SUCCESS"):
        headers.write.mode("overwrite").parquet(path)
    headers = spark.read.schema(headers.schema).parquet(path)
    groups = _run_stream(headers, base)
    if state:
        groups = groups.join(headers.select("digest").distinct(), "digest", "left_semi")
    groups = materialise(groups, "dedup_final")

    # the whole bytes, where a digest came more than once
    parts = F.ceil(F.col("n") / split).cast("int")
    again = groups.filter("n > 1").select("digest", "stays", parts.alias("parts"))
    hot = again.filter("parts > 1").select("digest", "parts")  # at most one for each ``split`` rows
    salted = again.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    texts = source.select(digest(F.col("__norm")).alias("digest"), "keep", "__norm")
    texts = texts.join(hot, "digest", "left").withColumn("salt", F.pmod(F.xxhash64("keep"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts") if not hot.isEmpty() else texts.withColumn("salt", F.lit(0))
    hits = materialise(texts.join(salted, ["digest", "salt"]).withColumn("first", F.col("keep") == F.col("stays")).drop("stays"), "dedup_hits")
    first = hits.filter("first").select("digest", "__norm")
    if state:
        earlier = materialise(again.join(first.select("digest"), "digest", "left_anti").select("digest", "stays"), "dedup_earlier")
        if not earlier.isEmpty():
            first = first.union(_earlier_texts(earlier, text))
    first = first.join(again.select("digest", "parts"), "digest").select("digest", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.col("__norm").alias("__other"))
    differing = materialise(hits.filter(~F.col("first")).join(first, ["digest", "salt"]).filter("__norm <> __other").select("digest"), "dedup_differing")

    sha = F.col("digest" if same else "sha").alias("text_sha256")
    result = headers.join(groups, "digest").select("keep", "digest", "stays", "n", sha)
    if not differing.isEmpty():
        mixed = differing.distinct()
        apart = hits.join(mixed, "digest", "left_semi")
        exact = apart.groupBy("digest", "__norm").agg(F.max("keep").alias("stays"), F.count("*").alias("n"))
        redone = apart.select("digest", "__norm", "keep").join(exact, ["digest", "__norm"]).select("keep", "digest", "stays", "n", sha256(F.col("__norm")).alias("text_sha256"))
        result = result.join(mixed, "digest", "left_anti").unionByName(redone)
    return result.select(
        F.col("keep.key").alias(key),
        F.struct("keep.file", "keep.row").alias("place"),
        F.col("stays.key").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("keep") == F.col("stays")).alias("kept"),
        "text_sha256",
    )


def drop_exact_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns."""
    source = locatable(df)
    at = dict(zip(df.columns, source.columns, strict=True))
    gone = exact_duplicates(source, at[key], at[text]).filter(~F.col("kept")).select(_named("place"))
    place = _free(source.columns, "place")
    rows = source.select("*", F.struct(*_place()).alias(place))
    return without(rows, _named(place), materialise(gone, "dedup_gone")).select(*(F.col(f"`{c}`") for c in source.columns)).toDF(*df.columns)


def _named(place: str) -> Column:
    return F.concat_ws(":", F.col(f"{place}.file"), F.col(f"{place}.row"))
