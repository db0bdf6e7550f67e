"""Run report."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _counted(df, extension, query, **counts):
    cols = {"New_Urls": 0, "Detections": 0, "Writes": 0, **counts}
    return df.select(
        extension.alias("Extension"),
        query.alias("Query"),
        *[F.lit(v).cast("bigint").alias(c) for c, v in cols.items()],
    )


def run_report(pairs: DataFrame, detected: DataFrame, written: DataFrame) -> DataFrame:
    """New URLs, detections and written rows per extension and query, with totals.

    ``pairs`` holds the new (file, query) rows with ``ext`` and ``query``; the
    other two hold ``Extension`` and ``query``. All three are counted in one
    aggregation; total rows have a null Query, the grand total also a null
    Extension.
    """
    rows = (
        _counted(pairs, F.col("ext"), F.col("query"), New_Urls=1)
        .unionByName(_counted(detected, F.col("Extension"), F.col("query"), Detections=1))
        .unionByName(_counted(written, F.col("Extension"), F.col("query"), Writes=1))
    )
    return rows.rollup("Extension", "Query").agg(
        *[F.sum(c).alias(c) for c in ("New_Urls", "Detections", "Writes")]
    )
