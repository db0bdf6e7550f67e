"""Which (file, query) was scanned before."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from credsieve import schemas


def fingerprint(url, query):
    """The extension searched for is not part of it."""
    return F.md5(F.concat(url, query))


def drop_seen(df: DataFrame, ledger: DataFrame) -> DataFrame:
    """Rows whose ``hashed_url`` the ledger does not hold."""
    return df.join(ledger.select("hashed_url"), "hashed_url", "left_anti")


def ledger_rows(df: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """New ledger rows of a run; partial aggregation collapses repeated URLs early."""
    rows = df.select("hashed_url", F.col("fetch_url").alias("url")).distinct()
    return rows if ledger is None else drop_seen(rows, ledger)


def latest_per_url(df: DataFrame) -> DataFrame:
    """Newest landed version of each URL.

    The rank filter is applied before the shuffle as well, so a URL landed
    very often costs one row per task. URLs start alike, so rows are sorted by a
    hash of the URL first: hardly a comparison reads the text.
    """
    newest = Window.partitionBy(F.xxhash64("html_url"), "html_url").orderBy(
        F.desc("indexed_at"), F.desc("file_id")
    )
    return df.withColumn("_version", F.row_number().over(newest)).where("_version = 1").drop("_version")


def file_ledger_rows(df: DataFrame) -> DataFrame:
    """Ledger columns of listed files: hash of the path, and of path and change time."""
    path = F.col("path")
    return df.select(
        F.md5(path).alias("hashed_files"),
        F.md5(F.concat(path, F.col("modified_ms").cast("string"))).alias("file_modification_hash"),
        path.alias("files"),
    ).select(*schemas.FILE_LEDGER)


def drop_seen_files(df: DataFrame, file_ledger: DataFrame) -> DataFrame:
    """Listed files that are new or were changed since they were scanned."""
    key = F.md5(F.concat(F.col("path"), F.col("modified_ms").cast("string")))
    seen = file_ledger.select("file_modification_hash")
    return (
        df.withColumn("file_modification_hash", key)
        .join(seen, "file_modification_hash", "left_anti")
        .drop("file_modification_hash")
    )


def unique_detections(df: DataFrame) -> DataFrame:
    """One detection per source, keyword, extension, URL and masked line.

    The kept row is the one with the highest score; among equals the smallest
    time stamp. Ranking, unlike picking any row, gives the same result when a
    task is run again.
    """
    best = Window.partitionBy(*schemas.FILE_UNIQUE).orderBy(
        F.desc("Score"), "Detected_Timestamp", *[c for c in ("Secret",) if c in df.columns]
    )
    return df.withColumn("_rank", F.row_number().over(best)).where("_rank = 1").drop("_rank")
