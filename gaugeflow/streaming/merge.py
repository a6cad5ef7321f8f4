"""Micro-batches merged into a dataset as they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from gaugeflow.sources.dataset import BeforeAxis, Dataset, merge_dataset


def merge_stream(series: DataFrame, stations: DataFrame, path: str, checkpoint: str, on_report: Callable[[int, dict], None] | None = None, **trigger) -> StreamingQuery:
    """Merge each micro-batch of a streamed series (station_ref, ts, value, ...) into the dataset at path.

    A merge is idempotent in values, so a batch that is repeated after a failure changes nothing. Times before the axis
    are dropped, a batch wholly before it is passed over; on_report gets the batch id and the report. trigger: as of
    DataStreamWriter.trigger, all that is available by default.
    """
    spark = series.sparkSession

    def merge(batch: DataFrame, batch_id: int) -> None:
        ds = Dataset(spark, path)
        try:
            _, report = merge_dataset(ds, stations, batch)
        except BeforeAxis:
            report = {"dropped_before_axis": batch.count()}
        if on_report:
            on_report(batch_id, report)

    return series.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
