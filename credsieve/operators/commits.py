"""Commit details and time stamps of a detection."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credsieve import schemas
from credsieve.functions.common import let
from credsieve.operators.partitioning import semi_join

_KEYS = ["owner", "repo", "file_path"]


def format_commits(status, body):
    """Reply of the commit history as compact JSON; ``{}`` unless the status is 200."""
    def text(c):
        return F.coalesce(c, F.lit(""))

    def reply(commits):
        rows = F.transform(
            commits,
            lambda c: F.struct(
                text(c["sha"]).alias("commit_id"),
                text(c["commit"]["author"]["email"]).alias("email"),
                text(c["commit"]["author"]["name"]).alias("commiter_name"),
                text(c["commit"]["author"]["date"]).alias("commit_date"),
                text(c["author"]["login"]).alias("user_id"),
            ),
        )
        return F.to_json(F.struct(status.alias("status"), rows.alias("commits")))

    parsed = let(F.from_json(body, schemas.COMMIT_BODY), lambda c: F.when(c.isNotNull(), reply(c)))
    return F.when(status == 200, F.coalesce(parsed, F.lit("{}"))).otherwise(F.lit("{}"))


def attach_commits(df: DataFrame, commits: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Add ``Commit_Details`` by (owner, repo, file_path); ``{}`` where unknown.

    Replies landed twice count once, a good one first. The JSON is parsed after
    the join, so only replies of files with a detection are. Rows per file are
    few: the candidates of one version of a file, see ``latest_per_url``.

    ``wanted``: a stored table with the keys of all rows of ``df``, repeated or
    not. Replies of other files then go before anything is grouped or shuffled,
    so the cost follows the detections and not the commit corpus.
    """
    if wanted is not None:
        commits = semi_join(commits, wanted.select(*_KEYS), _KEYS)
    one_reply = commits.groupBy(*_KEYS).agg(
        F.max(F.struct((F.col("status") == 200).alias("ok"), "status", "body")).alias("reply")
    )
    details = format_commits(F.col("reply.status"), F.col("reply.body"))
    return (
        df.join(one_reply, _KEYS, "left")
        .withColumn("Commit_Details", F.coalesce(details, F.lit("{}")))
        .drop("reply")
    )


def stamp(df: DataFrame, as_of: str) -> DataFrame:
    """Detection time ``as_of`` as text and as year, month, day and hour."""
    at = F.lit(as_of).cast("timestamp")
    return df.withColumns(
        {
            "Detected_Timestamp": F.date_format(at, "yyyy-MM-dd HH:mm:ss"),
            "Year": F.year(at),
            "Month": F.month(at),
            "Day": F.dayofmonth(at),
            "Hour": F.hour(at),
        }
    )
