"""Features of detections for the false-positive filter."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credsieve.operators.partitioning import left_join_hot
from credsieve.scratch import salted_hash, written

# Columns that identify a detection and are no features.
ID_COLUMNS = {
    "public": (
        "Source", "Primary_Key", "Commit_Details", "URL", "Owner", "Repo_Name",
        "Detected_Timestamp", "Year", "Month", "Day",
    ),
    "enterprise": (
        "Source", "Commit_Details", "URL", "Owner", "Repo_Name", "Detected_Timestamp",
        "Year", "Month", "Day",
    ),
    "files": ("Source", "URL", "Detected_Timestamp", "Year", "Month", "Day"),
}

NUMERIC = [
    "Key_Weight", "SKey_Count", "Entropy", "Dictionary_Similarity", "Score",
    "Len_Key", "Len_Code", "Has_Digit", "Has_Cap",
]
CATEGORICAL = ["Second_Key", "Extension"]


def has_digit(c):
    """Digits of any script, raised and lowered ones included."""
    return c.rlike(r"[\p{Nd}²³¹⁰-⁹₀-₉]").cast("int")


def has_capital(c):
    return c.rlike(r"\p{IsUppercase}").cast("int")


def has_special_chars(c):
    return c.rlike(r"[@_!#$%^&*()<>?/\\|}{~:]").cast("int")


def with_features(df: DataFrame) -> DataFrame:
    """Add the features taken from the secret and its line."""
    secret, code = F.col("Secret"), F.col("Code")
    return df.withColumns(
        {
            "Len_Key": F.length(secret),
            "Len_Code": F.length(code),
            "Has_Digit": has_digit(secret),
            "Has_Cap": has_capital(secret),
        }
    )


def engineer_features(df: DataFrame) -> DataFrame:
    return with_features(df).drop("Secret", "Code")


def drop_id_columns(df: DataFrame, source: str) -> DataFrame:
    return df.drop(*ID_COLUMNS[source])


def one_hot(df: DataFrame, values: dict) -> DataFrame:
    """Replace category columns by 0/1 columns ``<column>_<value>``.

    ``values`` names the categories per column, as the configured lists do.
    """
    plain = [F.col(c) for c in df.columns if c not in values]
    dummies = [
        F.coalesce((F.col(column) == F.lit(v)).cast("int"), F.lit(0)).alias(f"{column}_{v}")
        for column, vs in values.items()
        for v in vs
    ]
    return df.select(*plain, *dummies)


def align_columns(df: DataFrame, columns) -> DataFrame:
    """Exactly these columns: missing ones 0, others dropped."""
    present = set(df.columns)
    return df.select(
        *[
            F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(c) if c in present else F.lit(0).alias(c)
            for c in columns
        ]
    )


def apply_labels(df: DataFrame, review: DataFrame, max_rows=1_000_000) -> DataFrame:
    """Reviewed labels override the default 1; of several reviews the lowest counts.

    The same line may stand in very many files, so one reviewed line may label
    a large share of the rows. The reviews are written, as they are measured before
    they are joined, under a hash that names no secret.
    """
    line = salted_hash("Secret", "Code").alias("_line")
    lowest = review.groupBy("Secret", "Code").agg(F.min("Label").alias("_reviewed"))
    reviewed = written(lowest.select(line, "_reviewed").where("_line is not null"), "reviewed")
    return (
        left_join_hot(df.select("*", line), reviewed, ["_line"], max_rows)
        .withColumn("Label", F.coalesce("_reviewed", F.lit(1)))
        .select(*df.columns)
    )


def split_key(df: DataFrame, columns, seed=123):
    """0..99 by the content of a row: the same row always falls on the same side."""
    text = F.concat_ws("\u0001", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns])
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint"), F.lit(100))


def split(df: DataFrame, columns, train_percent=70, seed=123):
    """Training and test part of a labelled table, stable under recomputation."""
    part = split_key(df, columns, seed)
    return df.where(part < train_percent), df.where(part >= train_percent)
