"""Configuration lists, ledgers and training tables."""

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credsieve import resources as R
from credsieve import schemas
from credsieve.functions.domains import DomainTable

MAX_LIST = 100_000

KEYWORD_DEFAULTS = {
    "primary": (),
    "creds": R.SECONDARY_CREDS,
    "keys": R.SECONDARY_KEYS,
    "custom": (),
}


def _missing(error: AnalysisException) -> bool:
    return error.getCondition() == "PATH_NOT_FOUND"


def inline_list(spark: SparkSession, column: str, values) -> DataFrame:
    """A short list as a local relation, so its size is known to the optimizer."""
    return spark.createDataFrame(pa.table({column: pa.array(list(values), pa.string())}))


def read_list(spark: SparkSession, path: str, column: str) -> DataFrame:
    """One-column file with a header row; case, order marks of duplicates kept.

    The header is skipped whatever it says (a byte order mark included); blank
    lines are skipped; a missing file is an empty list.
    """
    schema = T.StructType([T.StructField(column, T.StringType())])
    try:
        lines = (
            spark.read.schema(schema)
            .option("header", True)
            .option("enforceSchema", True)
            .option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False)
            .csv(path)
        )
    except AnalysisException as error:
        if not _missing(error):
            raise
        return spark.createDataFrame([], schema)
    return lines.where(F.col(column).isNotNull())


def read_keywords(spark, path=None, kind="creds") -> DataFrame:
    """Keyword list from a file, or the default list of that kind."""
    if path is None:
        return inline_list(spark, "keyword", KEYWORD_DEFAULTS[kind])
    return read_list(spark, path, "keyword")


def read_extensions(spark, path=None) -> DataFrame:
    if path is None:
        return inline_list(spark, "type", R.EXTENSIONS)
    return read_list(spark, path, "type")


def read_stop_words(spark, path=None) -> DataFrame:
    """Stop words; blanks are significant."""
    if path is None:
        return inline_list(spark, "word", R.STOP_WORDS)
    return read_list(spark, path, "word")


def read_search_paths(spark, path) -> DataFrame:
    return read_list(spark, path, "scan_paths")


def read_target_files(spark, path) -> DataFrame:
    return read_list(spark, path, "target_file_paths")


def read_domains(spark, path) -> DataFrame:
    """Domain suffixes from a file of the usual form, one in a line.

    Comments (``#`` or ``//``) and exceptions (``!``) are left out; a wildcard (``*.``)
    counts as the suffix below it, since a label must stand before a suffix anyway. A
    missing file is an error.
    """
    name = F.regexp_extract("value", r"^\s*(?:\*\.)?([^\s#!/*]+)", 1)
    return spark.read.text(path).select(F.lower(name).alias("domain")).where("domain <> ''")


def domain_table(domains: DataFrame) -> DomainTable:
    """The table of suffixes that scans take as ``tlds``; lists hold some ten thousand."""
    return DomainTable.of(list_values(domains.distinct()))


def read_dictionary(spark, path) -> DataFrame:
    words = read_list(spark, path, "dic_word")
    if words.isEmpty():
        raise ValueError(f"no dictionary words in {path}")
    return words


def read_confidence(spark, path=None) -> DataFrame:
    """Weight per keyword or extension; an empty table or a repeated key is an error."""
    if path is None:
        keys, values = zip(*R.CONFIDENCE)
        return spark.createDataFrame(
            pa.table({"key": list(keys), "value": pa.array(values, pa.int32())})
        )
    table = (
        spark.read.schema("key string, value int").option("header", True).csv(path)
    ).where("key is not null")
    if table.isEmpty():
        raise ValueError(f"no confidence values in {path}")
    twice = table.groupBy("key").count().where("count > 1").orderBy("key").first()
    if twice is not None:
        raise ValueError(f"several confidence values for {twice['key']!r} in {path}")
    return table


def list_values(df: DataFrame) -> list:
    """Values of a configuration list (keywords, extensions, stop words).

    Lists become constants of the plan, so one of more than ``MAX_LIST`` rows
    is refused.
    """
    rows = df.limit(MAX_LIST + 1).collect()
    if len(rows) > MAX_LIST:
        raise ValueError(f"a configuration list may have at most {MAX_LIST} rows")
    return [row[0] for row in rows]


def _read_table(spark, path, schema, fmt) -> DataFrame:
    try:
        reader = spark.read.schema(schema)
        return reader.option("header", True).csv(path) if fmt == "csv" else reader.parquet(path)
    except AnalysisException as error:
        if not _missing(error):
            raise
        return spark.createDataFrame([], schema)


def read_url_ledger(spark, path, fmt="parquet") -> DataFrame:
    """Fingerprints of files scanned before; empty if there is no ledger yet."""
    return _read_table(spark, path, schemas.struct(schemas.URL_LEDGER), fmt).select("hashed_url")


def read_file_ledger(spark, path, fmt="parquet") -> dict:
    """Each ledger column de-duplicated on its own; empty if there is no ledger yet."""
    table = _read_table(spark, path, schemas.struct(schemas.FILE_LEDGER), fmt)
    return {c: table.select(c).distinct() for c in schemas.FILE_LEDGER}


def read_training(spark, path, fmt="csv") -> DataFrame:
    """Engineered training table, complete with its label."""
    if fmt == "csv":
        table = spark.read.option("header", True).option("inferSchema", True).csv(path)
    else:
        table = spark.read.format(fmt).load(path)
    if table.isEmpty():
        raise ValueError(f"training data is empty: {path}")
    return table


def training_columns(training: DataFrame) -> DataFrame:
    """Feature columns of the training table: everything but the label."""
    return training.drop("Label")
