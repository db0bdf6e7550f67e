"""Result tables, ledgers and training tables."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credsieve import schemas

ROUTE = ("source", "kind", "mode")


def _existing_columns(spark, path, fmt):
    """Columns of the table at ``path``; None if there is none."""
    try:
        reader = spark.read.format(fmt)
        return (reader.option("header", True) if fmt == "csv" else reader).load(path).columns
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def append_checked(df: DataFrame, path: str, fmt="parquet", partition_by=()) -> None:
    """Create the table or append to it; refused if columns or their order differ."""
    existing = _existing_columns(df.sparkSession, path, fmt)
    ours = [c for c in df.columns if c not in partition_by] + list(partition_by)
    if existing is not None and len(existing) != len(ours):
        raise ValueError(f"{path} has {len(existing)} columns, the rows have {len(ours)}")
    if existing is not None and existing != ours:
        raise ValueError(f"{path} has columns {existing}, the rows have {ours}")
    writer = df.write.format(fmt).mode("append").partitionBy(*partition_by)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)


def overwrite(df: DataFrame, path: str, fmt="parquet") -> None:
    writer = df.write.format(fmt).mode("overwrite")
    (writer.option("header", True) if fmt == "csv" else writer).save(path)


def route_output(df: DataFrame, path: str, source: str, kind: str, mode: str) -> None:
    """Append to the part of the table that belongs to a source, kind and run mode."""
    routed = df.withColumns({"source": F.lit(source), "kind": F.lit(kind), "mode": F.lit(mode)})
    append_checked(routed, path, partition_by=ROUTE)


def append_ledger(rows: DataFrame, path: str, source="enterprise", kind="creds", mode="plain"):
    """Append (hashed_url, url) rows of processed files to their ledger part."""
    route_output(rows.select(*schemas.URL_LEDGER), path, source, kind, mode)


def write_listing(files: DataFrame, path: str) -> None:
    """Replace the file listing."""
    overwrite(files.select(F.col("path").alias("target_file_paths")), path, "csv")


def append_training(rows: DataFrame, path: str, fmt="parquet") -> None:
    append_checked(rows.select(*schemas.TRAINING_SOURCE), path, fmt)
