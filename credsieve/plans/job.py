"""A complete run: scan once, then write detections and ledger and report."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credsieve.operators.ledger import drop_seen, ledger_rows
from credsieve.operators.queries import enterprise_query, has_terms, public_query
from credsieve.operators.report import run_report
from credsieve.plans.scan import (
    PUBLIC,
    ScanConfig,
    detections,
    scanned_pairs,
    scanned_versions,
    stage_files,
    training_config,
    unscanned,
)
from credsieve.scratch import remove, run_folder, written
from credsieve.sinks.runs import RunStore


def with_query(detected: DataFrame, config: ScanConfig) -> DataFrame:
    """Detections with the search query that led to them."""
    if config.source == PUBLIC:
        query = public_query(F.col("Primary_Key"), F.col("Second_Key"))
    else:
        query = enterprise_query(F.col("Second_Key"))
    return detected.withColumn("query", query)


def stopped_files(staged: DataFrame) -> DataFrame:
    """(Extension, Files): files with a search term that a gate stopped."""
    gated = staged.where("hits is null").groupBy(F.col("ext").alias("Extension"))
    return gated.agg(F.count("*").alias("Files"))


def run_scan(
    files: DataFrame, config: ScanConfig, ledger=None, scanned=None, model=None, **inputs
) -> dict:
    """``detections``, new ``ledger`` rows, ``report``, ``scanned`` and ``stopped`` of one run.

    The body pass is written once; the results read its narrow rows. They are
    written too, and what the run wrote besides, plain secrets among it, is removed
    when it ends, however it ends.

    ``scanned`` lists the version of each URL that was scanned. Given the ``ledger``
    and ``scanned`` rows of all earlier runs, a run finds what it would find with the
    ledger alone, but reads only the bodies that landed since. ``stopped`` counts the
    files with a search term that a gate of the configuration kept out, per extension.
    """
    with run_folder(files.sparkSession):
        if scanned is not None:
            files = unscanned(files, scanned, config)
        every = written(stage_files(files, config, every=True), "staged")
        staged = every.where(has_terms())
        pairs = scanned_pairs(staged, config)
        if ledger is not None:
            pairs = drop_seen(pairs, ledger)
        found = detections(
            staged, config, ledger=ledger, model=model, stored=True, predicted=True, **inputs
        )
        kept = all_found = written(found, "detections", keep=model is None)
        if model is not None:
            real = all_found.where("prediction <> 0").drop("prediction")
            kept = written(real, "detections", keep=True)
        report = run_report(pairs, with_query(all_found, config), with_query(kept, config))
        return {
            "detections": kept,
            "ledger": written(ledger_rows(pairs), "ledger", keep=True),
            "report": written(report, "report", keep=True),
            "scanned": written(scanned_versions(every, config), "scanned", keep=True),
            "stopped": written(stopped_files(staged), "stopped", keep=True),
        }


def committed_run(store: RunStore, run: str, files: DataFrame, config: ScanConfig, **inputs) -> bool:
    """A run against the ledger and scanned versions in ``store``, whose tables enter it in
    one step; false, and nothing is scanned, if the run of that name is in it already.

    A run that broke off anywhere is done over as if it had never been; see ``RunStore``.
    """
    if run in store.runs():
        return False
    ledger, scanned = store.read("ledger"), store.read("scanned")
    out = run_scan(files, config, ledger=ledger, scanned=scanned, **inputs)
    try:
        return store.commit(run, out)
    finally:
        for table in out.values():
            remove(files.sparkSession, table.scratch_path)


def run_collection(files: DataFrame, config: ScanConfig, ledger=None, **inputs) -> dict:
    """``training`` rows and new ``ledger`` rows of a collection run; a later run that is
    given the ledger collects from new files only."""
    config = training_config(config)
    with run_folder(files.sparkSession):
        staged = written(stage_files(files, config), "staged")
        pairs = scanned_pairs(staged, config)
        if ledger is not None:
            pairs = drop_seen(pairs, ledger)
        rows = detections(staged, config, ledger=ledger, stored=True, **inputs).withColumn("Label", F.lit(1))
        return {
            "training": written(rows, "training", keep=True),
            "ledger": written(ledger_rows(pairs), "ledger", keep=True),
        }
