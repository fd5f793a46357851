"""I9 + P14: score free text as it arrives, with the same function as batch scoring.

Guard -> model transform -> prediction record runs append-only into a file
sink whose progress is kept in a checkpoint folder under the session's
checkpoint directory, so a restarted query resumes without duplicates.
``availableNow`` processes what is there and stops.  With ``session`` the stop
word ends its conversation (:mod:`sardonyx.streaming.sessions`): what comes
after it is not scored, also in later micro-batches and after a restart.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from sardonyx.operators.scoring import prompt_guard
from sardonyx.plans.training import score
from sardonyx.session import scratch_dir
from sardonyx.streaming.sessions import open_stream


def scoring_stream(stream: DataFrame, model: PipelineModel, keep=("text",), session: str | None = None,
                   order: str = "turn") -> DataFrame:
    """Guard + score a streaming DataFrame with a ``text`` column (or a batch one, without ``session``)."""
    if session:
        stream = open_stream(stream, session, order)
    return score(model, prompt_guard(stream, "text"), keep=keep)


def run_available(spark: SparkSession, source_dir: str, schema: str, model: PipelineModel,
                  keep=("text",), sink_path: str | None = None, checkpoint: str | None = None,
                  fmt: str = "parquet", file_glob: str | None = None,
                  max_files_per_trigger: int = 1000, session: str | None = None, order: str = "turn") -> DataFrame:
    """Start the stream over the files of ``source_dir`` (optionally only those matching
    ``file_glob``), process all available input, and return the sink table.

    ``availableNow`` honours ``maxFilesPerTrigger``: a large backlog is cut into
    several bounded micro-batches instead of one batch of everything.  ``session`` names
    the column whose stop words end a session, ``order`` the order within it.
    """
    sink_path = sink_path or scratch_dir(spark, "scored-stream")
    checkpoint = checkpoint or scratch_dir(spark, "scored-stream-ckpt")
    reader = (spark.readStream.schema(schema).format(fmt)
              .option("maxFilesPerTrigger", max_files_per_trigger))
    if file_glob:
        reader = reader.option("pathGlobFilter", file_glob)
    src = reader.load(source_dir)
    q = (scoring_stream(src, model, keep, session, order).writeStream.format("parquet").outputMode("append")
         .option("path", sink_path).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(sink_path)
