"""The batch decision function applied to a stream: stateless, so no watermark and no state store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.decide import decide


def start_decision_log(
    scored: DataFrame, path: str, checkpoint: str, moment: Column | None = None, hosts: DataFrame | None = None,
    available_now: bool = False, trigger: str = "10 seconds",
) -> StreamingQuery:
    """Append decisions to Parquet below `path`, exactly once by way of the file sink's own log.

    `checkpoint` must be on storage all executors share. `available_now` works off what has arrived
    and stops.
    """
    writer = decide(scored, moment, hosts).writeStream.format("parquet").outputMode("append").option(
        "path", path
    ).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=trigger)
    return writer.start()
