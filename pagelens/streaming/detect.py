"""Risk verdicts over a stream of captures: detectors have no state, each micro-batch is scored as a table would be."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.scan import Landed, verdicts_of
from ..sources.captures import normalised


def score_stream(spark: SparkSession, captures: DataFrame, out_path: str, checkpoint: str, landed: Landed = Landed()) -> StreamingQuery:
    """Scores captures as they land, with the tables of what landed for them, and appends verdicts to out_path. A batch that is run again replaces its own folder."""

    def one(batch: DataFrame, batch_id: int) -> None:
        verdicts_of(normalised(batch), landed).write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    return captures.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
