"""Suspicion weights of keywords and extensions."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def key_weight(df: DataFrame, confidence: DataFrame, keyword="kw", extension="ext") -> DataFrame:
    """Add ``keyword_weight``, ``extension_weight`` and their sum ``Key_Weight``.

    Unknown keys weigh 0; of several weights of a key the highest counts, so no
    row is repeated. The weight table is a short list whose size the optimizer
    knows, so it decides on the broadcast.
    """
    confidence = confidence.groupBy("key").agg(F.max("value").alias("value"))
    by_keyword = confidence.select(
        F.col("key").alias(keyword), F.col("value").alias("keyword_weight")
    )
    by_extension = confidence.select(
        F.col("key").alias(extension), F.col("value").alias("extension_weight")
    )
    joined = df.join(by_keyword, keyword, "left").join(by_extension, extension, "left")
    zero = F.lit(0)
    return joined.withColumns(
        {
            "keyword_weight": F.coalesce("keyword_weight", zero),
            "extension_weight": F.coalesce("extension_weight", zero),
            "Key_Weight": (
                F.coalesce("keyword_weight", zero) + F.coalesce("extension_weight", zero)
            ).cast("int"),
        }
    )


def unweighted_keywords(keywords: DataFrame, confidence: DataFrame) -> DataFrame:
    """Data-quality report: keywords without a weight."""
    return (
        keywords.select("keyword")
        .distinct()
        .join(confidence.select(F.col("key").alias("keyword")), "keyword", "left_anti")
    )
