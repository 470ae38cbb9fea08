"""Incremental ingestion: a file stream whose batches upsert into a keyed store. The stream's checkpoint tracks which files were taken."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.log_store import Store


def ingest(spark: SparkSession, source: str, schema: str, store: Store, checkpoint: str, order: str | None = None, transform=None, name: str | None = None, files: int = 64) -> int:
    """Takes all new Parquet files of a folder, in batches, and returns how many batches changed the store. Each writes its own rows only.

    A batch's number is committed with its rows under the stream's name (its checkpoint, unless given), so a batch that runs again after a crash changes nothing.
    """
    done = 0

    def batch(df: DataFrame, number: int) -> None:
        nonlocal done
        done += store.upsert(transform(df) if transform else df, order, stream=(name or checkpoint, number))

    q = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return done
