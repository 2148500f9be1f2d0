"""A folder that scans are dropped into, as a stream of batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.batch import BatchRequest, encode, regions
from ..sources.images import is_supported, read_images

FILES = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str, request: BatchRequest = BatchRequest(), once: bool = False) -> StreamingQuery:
    """Encode every new image into Parquet under ``out``, one folder for each batch, which a repeated batch replaces."""
    files = spark.readStream.format("binaryFile").schema(FILES).load(folder).select("path", "length").filter(is_supported(F.col("path")))

    def put(batch: DataFrame, number: int) -> None:
        paths = [r["path"] for r in batch.select("path").toLocalIterator()]  # names of one batch's files
        if paths:
            images = read_images(spark, paths)
            encode(images, regions(images, request.frames), request).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = files.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
