"""Test results as a stream: files of new runs are appended to the history table, once per batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def runs_stream(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def append_runs(runs: DataFrame, table_path: str, checkpoint: str, watermark: str = "1 day"):
    """Starts a query that drops repeats of a run (by run_id, within the watermark) and appends to Parquet."""
    fresh = runs.withWatermark("executed_at", watermark).dropDuplicatesWithinWatermark(["run_id"])
    return fresh.writeStream.format("parquet").option("path", table_path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def daily(runs: DataFrame, table_path: str, checkpoint: str, watermark: str = "1 day"):
    """Starts a query that counts runs and failures by day. Each batch writes the days it has changed to a folder of its own,
    so that a batch that is repeated replaces itself; a day's greatest counts are its last ones."""
    counted = runs.withWatermark("executed_at", watermark).groupBy(F.window("executed_at", "1 day").alias("w")).agg(F.count("*").alias("runs"), F.count_if(~F.col("passed")).alias("failures"))

    def one(batch: DataFrame, number: int) -> None:
        batch.select(F.col("w.start").alias("day"), "runs", "failures").write.mode("overwrite").parquet(f"{table_path}/batch={number}")

    return counted.writeStream.outputMode("update").foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
