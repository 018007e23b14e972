"""Incremental index maintenance as a stream: each micro-batch appends what isn't stored yet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def append_new(spark: SparkSession, source: str, schema: str, target: str, key: str, checkpoint: str) -> None:
    """Reads new files of ``source``, and appends rows whose key isn't in ``target``. One pass over what is there, then it ends.

    A batch that is repeated after a failure finds its keys stored and appends nothing.
    """

    def write(batch: DataFrame, _: int) -> None:
        batch = batch.dropDuplicates([key])
        try:
            batch = batch.join(spark.read.parquet(target).select(key), key, "left_anti")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        batch.write.mode("append").parquet(target)

    spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
