"""Scan of files on a mounted file system or in a store, for credentials and keys."""

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credsieve import schemas
from credsieve.functions import clean, urls
from credsieve.operators.ledger import drop_seen_files, file_ledger_rows, unique_detections
from credsieve.operators.queries import has_extension, has_terms
from credsieve.plans.scan import CREDS, FILES, KEYS, ScanConfig, detections, stage_kinds
from credsieve.resources import EXTENSIONS
from credsieve.scratch import run_folder, written
from credsieve.sources.local_files import listed_files, read_bodies, walk


def local_code_files(listing: DataFrame, open_store=None) -> DataFrame:
    """Listed files in the shape the scans read; the path stands for the URL."""
    return read_bodies(listing, open_store).select(
        F.xxhash64("path").alias("file_id"),
        F.col("path").alias("html_url"),
        F.timestamp_millis("modified_ms").alias("indexed_at"),
        "content",
        "error",
    )


def _kinds(config):
    config = replace(config or ScanConfig(), source=FILES, columns=tuple(schemas.FILE_DETECTIONS))
    return [replace(config, kind=kind, keywords=config.keywords) for kind in (CREDS, KEYS)]


def run_file_scan(
    spark: SparkSession, paths, extensions=EXTENSIONS, config=None, file_ledger=None,
    open_store=None, **inputs
) -> dict:
    """``detections``, file ``ledger`` rows and ``unreadable`` paths of a run over folders.

    Files in the ledger are skipped unless changed. Each file is read once, in the task
    that searches it for credentials and for keys; its body is not shuffled or copied. An
    unreadable file or folder, or a root that is not there, is listed with the reason and
    enters no ledger. ``paths`` may be URIs of stores, see ``walk``. Tables that hold plain secrets are removed at the end of the run.
    """
    kinds = _kinds(config)
    with run_folder(spark):
        entries = written(walk(spark, paths, open_store), "entries")
        listing = listed_files(entries, extensions)
        if file_ledger is not None:
            listing = drop_seen_files(listing, file_ledger)
        listing = written(listing, "listing")
        ext = urls.url_extension(F.col("path"))
        to_read = listing.where(clean.not_markdown(ext) & has_extension(ext, kinds[0].extensions))
        staged = written(stage_kinds(local_code_files(to_read, open_store), kinds, ["error"]), "staged")
        found = None
        for k, kind in enumerate(kinds):
            own = staged.withColumns(
                {"found": F.col(f"found_{k}"), "hits": F.col(f"hits_{k}")}
            ).withColumn("found_primary", F.col("no_primary"))
            part = detections(own.where(has_terms()), kind, stored=True, **inputs)
            found = part if found is None else found.unionByName(part)
        unique = unique_detections(found)
        failed = staged.where("error is not null").select(F.col("html_url").alias("path"), "error")
        unread = entries.where("error is not null").select("path", "error").unionByName(failed)
        readable = listing.join(failed, "path", "left_anti")
        keep_secret = kinds[0].keep_secret
        return {
            "detections": written(unique if keep_secret else unique.drop("Secret"), "detections", keep=True),
            "ledger": written(file_ledger_rows(readable), "file-ledger", keep=True),
            "unreadable": written(unread.distinct(), "unreadable", keep=True),
        }


def scan_files(
    spark: SparkSession, paths, extensions=EXTENSIONS, config=None, file_ledger=None, **inputs
) -> DataFrame:
    """Detections of ``run_file_scan``."""
    return run_file_scan(spark, paths, extensions, config, file_ledger, **inputs)["detections"]
