"""Seasonal rainfall over a stream of daily values."""

from __future__ import annotations

from pyspark.sql import DataFrame

from terrainflow.operators.rainfall import RainfallConfig, seasonal_rainfall


def seasonal_totals_stream(daily: DataFrame, path: str, checkpoint: str, config: RainfallConfig = RainfallConfig()):  # noqa: B008
    """Starts a query that keeps the totals of each site up to date: every batch writes the full table as Parquet under path/batch=<n>.

    The aggregate is the one of the batch operator; its state is one row a site, so it needs no watermark.
    """
    totals = seasonal_rainfall(daily, config)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return totals.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).start()
