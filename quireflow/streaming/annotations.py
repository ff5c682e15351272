"""Annotations as a stream of files, through the same stateless transformations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quireflow import schemas
from quireflow.sources.annotations import with_source


def stream_annotations(spark: SparkSession, path: str, files: int = 1000) -> DataFrame:
    """One row per JSON document as files arrive, up to `files` in a batch."""
    reader = spark.readStream.schema(schemas.ANNOTATION).option("multiLine", True).option("maxFilesPerTrigger", files)
    return with_source(reader.json(path))


def run_each(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Appends transform(batch) to Parquet for each batch that is there now, then stops."""

    def write(batch: DataFrame, epoch: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
