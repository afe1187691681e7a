"""Scoring a stream with a fitted model.

The reference has no streams; what carries over is that scoring (MDL2) is a
projection, so a fitted pipeline applies unchanged to a streaming DataFrame,
and the submission sink (SRC2) becomes a checkpointed file stream.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.models import score


def score_stream(model: PipelineModel, stream: DataFrame, key: str, out: str = "predicted") -> DataFrame:
    """(key, predicted class) for every arriving row; stateless, no watermark needed."""
    return score(model, stream, out).select(key, out)


def write_predictions(scored: DataFrame, path: str, checkpoint: str, fmt: str = "csv",
                      trigger_once: bool = False) -> StreamingQuery:
    """Append predictions to files; the checkpoint gives exactly-once output on restart."""
    writer = (scored.writeStream.format(fmt).option("header", True).option("path", path)
              .option("checkpointLocation", checkpoint).outputMode("append"))
    if trigger_once:
        writer = writer.trigger(availableNow=True)
    return writer.start()
