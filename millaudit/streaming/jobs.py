"""Streams: arriving reports and verdict reuse with expiry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millaudit.operators import standards
from millaudit.sources.store import VerdictStore


def run_arrivals(
    stream: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, files_available_only: bool = True
):
    """Audits arriving rows with a per-row transformation and appends the results.

    Every micro-batch writes its own folder and overwrites it when it runs again, so a batch repeated
    after a failure never doubles rows. Returns the running query.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if files_available_only:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def run_verdict_reuse(
    spark: SparkSession, requests: DataFrame, registry: DataFrame, store: VerdictStore, now_of: Callable[[int], float],
    out: str, checkpoint: str,
):
    """Answers arriving requests from the verdict store; what is missing or expired is judged and stored.

    A micro-batch is reduced to distinct (code, production date) first, so a key asked for a million
    times is looked up once. ``now_of`` gives the time of a batch. Batch n reads the highest
    version up to n and writes version n + 1 (version 0 is the store before the stream), so a batch repeated
    after its write reads the same snapshot again and replaces its own.
    """

    def answer(batch: DataFrame, batch_id: int) -> None:
        asked = batch.select("code", "production_date").distinct()
        results, fresh_store = standards.validated(asked, registry, store.read(below=batch_id + 1), now_of(batch_id))
        results.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        store.write(fresh_store, batch_id + 1)

    return (
        requests.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
