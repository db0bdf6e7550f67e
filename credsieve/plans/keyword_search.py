"""Custom keyword search: which files mention a word, and who committed them."""

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credsieve import schemas
from credsieve.operators.commits import attach_commits, stamp
from credsieve.operators.ledger import drop_seen, fingerprint, latest_per_url, ledger_rows
from credsieve.operators.queries import enterprise_query, has_terms, match_files
from credsieve.plans.scan import PUBLIC, ScanConfig, with_fetch_url
from credsieve.scratch import run_folder, written


def keyword_files(files: DataFrame, keywords, config: ScanConfig, ledger=None) -> DataFrame:
    """One row per (file, keyword) the ledger does not hold, with URL parts and fingerprint.
    The body only serves to find the word."""
    matched = match_files(files, keywords, every=config.dedupe)
    matched = matched.select("file_id", "html_url", "indexed_at", "found", "found_primary")
    if config.dedupe:
        matched = latest_per_url(matched).where(has_terms())
    rows = matched.drop("found_primary").withColumn("kw", F.explode("found.kw")).drop("found")
    rows = with_fetch_url(rows, config).withColumn("query", enterprise_query(F.col("kw")))
    rows = rows.withColumn("hashed_url", fingerprint(F.col("fetch_url"), F.col("query")))
    return rows if ledger is None else drop_seen(rows, ledger)


def keyword_detections(rows: DataFrame, config: ScanConfig, commits=None, wanted=None) -> DataFrame:
    """Report rows of ``keyword_files``. Public results report the keyword with its
    quotes, enterprise ones without. ``wanted``: see ``attach_commits``."""
    if commits is not None:
        rows = attach_commits(rows, commits, wanted)
    else:
        rows = rows.withColumn("Commit_Details", F.lit("{}"))
    shown = F.col("query") if config.source == PUBLIC else F.col("kw")
    rows = stamp(rows, config.as_of).withColumns(
        {
            "Source": F.lit(f"{config.source_prefix}_{config.source.capitalize()}"),
            "Second_Key": shown,
            "Owner": F.col("owner"),
            "Repo_Name": F.col("repo"),
        }
    )
    return rows.select(*schemas.KEYWORD_DETECTIONS)


def search_keywords(
    files: DataFrame, keywords, config: ScanConfig, ledger=None, commits=None
) -> DataFrame:
    """One row per new (file, keyword). With ``commits`` the files found are written first,
    so that only their commits are grouped."""
    rows = keyword_files(files, keywords, config, ledger)
    if commits is None:
        return keyword_detections(rows, config)
    rows = written(rows, "found")
    return keyword_detections(rows, config, commits, wanted=rows)


def run_search(files, keywords, config: ScanConfig, ledger=None, commits=None) -> dict:
    """``detections`` and new ``ledger`` rows of a search; the files are read once. A later
    search that is given the ledger reports new files only."""
    with run_folder(files.sparkSession):
        rows = written(keyword_files(files, keywords, config, ledger), "found")
        found = keyword_detections(rows, config, commits, wanted=rows)
        return {
            "detections": written(found, "detections", keep=True),
            "ledger": written(ledger_rows(rows), "ledger", keep=True),
        }


def search_public(files, keywords, config=None, **inputs) -> DataFrame:
    return search_keywords(files, keywords, replace(config or ScanConfig(), source=PUBLIC), **inputs)


def search_enterprise(files, keywords, config=None, **inputs) -> DataFrame:
    return search_keywords(
        files, keywords, replace(config or ScanConfig(), source="enterprise"), **inputs
    )
