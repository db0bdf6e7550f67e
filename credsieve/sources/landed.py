"""Landed search results, file bodies and commit history."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def search_results(df: DataFrame) -> DataFrame:
    """URL, path and repository of each search item, all pages together."""
    return df.select(
        "html_url", "path", F.col("repository.full_name").alias("full_name"), "indexed_at"
    )


def code_files(df: DataFrame) -> DataFrame:
    """File bodies; rows without a body are skipped."""
    return df.select("file_id", "html_url", "indexed_at", "content").where(
        F.col("content").isNotNull()
    )


def commits(df: DataFrame) -> DataFrame:
    """Commit history replies, one per file."""
    return df.select("owner", "repo", "file_path", "status", "body")
