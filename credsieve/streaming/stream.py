"""Scans of files as they land."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from credsieve.plans.job import run_scan
from credsieve.plans.keyword_search import run_search
from credsieve.plans.scan import ScanConfig
from credsieve.scratch import remove, written
from credsieve.sinks.seen import SeenLedger


#: Batches after which the parts of a stream's ledger are merged.
MERGE_EVERY = 10


def batch_name(batch_id: int) -> str:
    """Name of a batch's part of a ledger; names sort like numbers."""
    return f"{batch_id:012d}"


def scan_stream(
    files: DataFrame, config: ScanConfig, detections_path, ledger_path, checkpoint,
    trigger=None, **inputs
) -> StreamingQuery:
    """Run the batch scan on each landed batch against the ledger of earlier ones.

    The detections of a batch go to a folder and its ledger rows to a part of the bucketed
    ledger at ``ledger_path``, both named by the batch; a replay replaces them, so a batch
    counts once however often it is run. Parts are merged every ``MERGE_EVERY`` batches.
    ``trigger``: arguments of the stream's trigger; all that has landed and no more, if
    not given.
    """

    def run(batch, ledger):
        return run_scan(batch, config, ledger=ledger, **inputs)

    return _each_batch(files, run, detections_path, ledger_path, checkpoint, trigger)


def search_stream(
    files: DataFrame, keywords, config: ScanConfig, detections_path, ledger_path, checkpoint,
    trigger=None, **inputs
) -> StreamingQuery:
    """The keyword search in the same way."""

    def run(batch, ledger):
        return run_search(batch, keywords, config, ledger=ledger, **inputs)

    return _each_batch(files, run, detections_path, ledger_path, checkpoint, trigger)


def _each_batch(files, run, detections_path, ledger_path, checkpoint, trigger):
    def handle(batch, batch_id):
        spark, name = batch.sparkSession, batch_name(batch_id)
        ledger = SeenLedger(spark, ledger_path)
        # A replayed batch does not see its own rows.
        out = run(batch, ledger.read(before=name).select("hashed_url"))
        out["detections"].write.mode("overwrite").parquet(f"{detections_path}/batch_id={batch_id}")
        ledger.append(out["ledger"], name)
        for table in out.values():
            remove(spark, table.scratch_path)
        _merge_now_and_then(ledger, batch_id)

    return (
        files.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _merge_now_and_then(ledger, batch_id):
    """Merge the parts of batches that can no longer be replayed."""
    if batch_id % MERGE_EVERY == MERGE_EVERY - 1:
        ledger.merge(batch_name(batch_id - 1))


def unseen_stream(
    rows: DataFrame, out_path, ledger_path, checkpoint, delay="1 day", event_time="indexed_at",
    trigger=None,
) -> StreamingQuery:
    """One row per fingerprint for ever, not only within the delay.

    Repeats within ``delay`` meet in the watermarked state, which is bounded by it. What
    leaves the state goes through the bucketed ledger of all earlier batches, which each
    batch reads anew, so a fingerprint that comes back after any time is dropped there.
    ``rows`` have ``hashed_url``, ``url`` and the event time.
    """

    def handle(batch, batch_id):
        spark, name = batch.sparkSession, batch_name(batch_id)
        ledger = SeenLedger(spark, ledger_path)
        found = written(batch, "unseen")
        new = ledger.drop_seen(found, before=name)
        new.write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")
        ledger.append(found, name)
        remove(spark, found.scratch_path)
        _merge_now_and_then(ledger, batch_id)

    return (
        drop_seen_stream(rows, delay, event_time)
        .writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def drop_seen_stream(rows: DataFrame, delay="1 day", event_time="indexed_at") -> DataFrame:
    """One row per fingerprint within the delay; the state is bounded by it."""
    timed = rows.withColumn(event_time, F.col(event_time).cast("timestamp"))
    return timed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["hashed_url"])


def detections_per_window(
    rows: DataFrame, width="1 hour", delay="1 day", event_time="indexed_at"
) -> DataFrame:
    """Detections per time window, kind and owner, for a batch or a stream."""
    rows = rows.withColumn(event_time, F.col(event_time).cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark(event_time, delay)
    return (
        rows.groupBy(F.window(event_time, width).alias("w"), "kind", "owner")
        .agg(F.count("*").alias("detections"))
        .select(
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "kind",
            "owner",
            "detections",
        )
    )
