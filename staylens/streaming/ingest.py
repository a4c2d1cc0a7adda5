"""Streaming ingestion: files that arrive go into all stores once; the checkpoint replaces a row offset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..models import Embedder, HashEmbedder
from ..plans.build import ingest_comments
from ..schema import COMMENTS


def comment_stream(spark: SparkSession, folder: str, files_per_trigger: int = 64) -> DataFrame:
    """Comments from Parquet files as they arrive in a folder."""
    return spark.readStream.schema(COMMENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def ingest(spark: SparkSession, folder: str, stores: str, checkpoint: str, embedder: Embedder | None = None, stop_words: DataFrame | None = None) -> StreamingQuery:
    """Runs over all files not seen yet and ends: records, vectors and index of the comments under ``stores`` are brought up to date.

    A comment that comes again replaces what is stored if it differs; a batch that is repeated after a
    failure changes nothing.
    """
    embedder = embedder or HashEmbedder()

    def upsert(batch: DataFrame, _: int) -> None:
        ingest_comments(batch.sparkSession, stores, batch, embedder, stop_words)

    stream = comment_stream(spark, folder)
    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
