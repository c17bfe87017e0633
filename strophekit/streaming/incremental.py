"""Incremental scoring of newly landed model outputs (Structured Streaming).

The reference scores one output file at a time; on a cluster new output
files keep landing.  ``score_stream`` reads them as a file stream with an
explicit schema and scores every micro-batch with the same in-row plan as
the batch job (X1).  Scores are appended to a parquet table partitioned by
the micro-batch id; a retried batch overwrites only its own partition, so
the sink stays exactly-once under executor or driver restarts (the
checkpoint must live in the shared folder).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strophekit.plans.scoring import score_songs
from strophekit.sources.io import SONGS_SCHEMA


def score_stream(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint: str,
                 measures: Sequence[str] = ("string_similarity", "head_similarity", "tail_similarity"),
                 sides: dict[str, str] | None = None, keys: Sequence[str] = ("id",),
                 schema: str = SONGS_SCHEMA, max_files_per_trigger: int = 100,
                 once: bool = False):
    """Start the stream; returns the ``StreamingQuery``."""
    sides = sides or {"pred": "model_response", "target": "target_response"}
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
              .json(source_dir))

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        scored = score_songs(batch, list(keys), sides, list(measures),
                             refusal_col=sides.get("pred"))
        (scored.withColumn("batch_id", F.lit(batch_id))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(sink_dir))

    writer = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer
    return writer.start()
