"""Incremental file input: the batch functions over new files as they arrive. An extension; results are those of a batch run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def incremental(spark: SparkSession, source: str, schema: str | StructType, step: Callable[[DataFrame], DataFrame], out: str, state: str, files: int = 1000) -> StreamingQuery:
    """Runs step on the rows of each lot of new Parquet files and appends what it returns; state holds what has been done."""

    def append(batch: DataFrame, number: int) -> None:
        # One folder per lot: a lot that is run again replaces its own rows.
        step(batch).write.mode("overwrite").parquet(f"{out}/lot={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    return stream.writeStream.foreachBatch(append).option("checkpointLocation", state).trigger(availableNow=True).start()
