"""The candidate filter as a stream: a checkpoint in place of looking which results exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import detections


def filter_new_detections(spark: SparkSession, source: str, schema: str, layout: DataFrame, target: str, checkpoint: str) -> None:
    """Filter the detection files that came since the last call and append accepted and rejected views under
    target. Files hold whole pages, so pages are renumbered within their batch."""

    def save(batch: DataFrame, batch_id: int) -> None:
        decided = detections.decide(batch, layout)
        detections.accepted(decided).write.mode("overwrite").parquet(f"{target}/accepted/batch={batch_id}")
        detections.rejected(decided).write.mode("overwrite").parquet(f"{target}/rejected/batch={batch_id}")

    stream = spark.readStream.schema(schema).parquet(source)
    query = stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
