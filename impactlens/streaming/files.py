"""Changes of files as a stream: each batch makes the stored results that depend on a changed file stale."""

from __future__ import annotations

from pyspark.sql import DataFrame

from impactlens.operators import changes


def invalidate(events: DataFrame, keys, stale_path: str, checkpoint: str):
    """Starts a query on file events (path, changed_at); each batch appends the cache_key of entries that depend on one of
    its files, with the batch's number. `keys` gives the table of entries (cache_key, files) as it is then. A batch that is
    repeated after a failure replaces its own folder, so each key is reported once per batch."""

    def one(batch: DataFrame, number: int) -> None:
        changes.stale(batch.select("path").distinct(), keys()).write.mode("overwrite").parquet(f"{stale_path}/batch={number}")

    return events.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
