"""A ledger that grows: bucketed by fingerprint, one part per run, merged now and then."""

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credsieve import schemas
from credsieve.scratch import exists, file_system, remove

BUCKETS = 32
#: Fingerprints up to which a lookup names them in its filter, so that only their buckets
#: are read; more are joined bucket by bucket.
FEW = 1000
_ABOUT, _MERGED = "_buckets", "-merged-"


class SeenLedger:
    """Fingerprints of processed files at ``path``, in ``buckets`` by fingerprint.

    A join with it shuffles the other side only, into the same buckets. Each run adds a
    part, which doing the run over replaces, so a run counts once. ``merge`` makes one part
    of many. All sessions find the number of buckets at the path, where the first put it.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path = spark, path.rstrip("/")
        self.table = "seen_" + hashlib.md5(self.path.encode()).hexdigest()
        if not exists(spark, f"{self.path}/{_ABOUT}/_SUCCESS"):
            about = spark.createDataFrame([(buckets,)], "buckets int").coalesce(1)
            about.write.mode("overwrite").json(f"{self.path}/{_ABOUT}")
        self.buckets = spark.read.schema("buckets int").json(f"{self.path}/{_ABOUT}").first()[0]
        location = self.path.replace("'", "\\'")
        spark.sql(
            f"""CREATE TABLE IF NOT EXISTS {self.table} (hashed_url STRING, url STRING, run STRING)
            USING parquet PARTITIONED BY (run)
            CLUSTERED BY (hashed_url) SORTED BY (hashed_url) INTO {self.buckets} BUCKETS
            LOCATION '{location}'"""
        )

    def runs(self) -> list[str]:
        """Names of the parts, in order."""
        system, folder = file_system(self.spark, self.path)
        names = [s.getPath().getName() for s in system.listStatus(folder)]
        return sorted(n.removeprefix("run=") for n in names if n.startswith("run="))

    def append(self, rows: DataFrame, run: str) -> None:
        """Add (hashed_url, url) rows as the part ``run``; an earlier part of that name is
        replaced. Names sort in the order of the runs. One file per bucket."""
        if not run.replace("-", "").isalnum():
            raise ValueError(f"not a name of a run: {run!r}")
        rows = rows.select(*schemas.URL_LEDGER).repartition(self.buckets, "hashed_url")
        rows.sparkSession.sql(
            f"INSERT OVERWRITE TABLE {self.table} PARTITION (run = '{run}') SELECT * FROM {{rows}}",
            rows=rows,
        )

    def read(self, before: str | None = None) -> DataFrame:
        """hashed_url and url of all parts, or of those named before ``before``."""
        self.spark.sql(f"MSCK REPAIR TABLE {self.table} SYNC PARTITIONS")
        self.spark.catalog.refreshTable(self.table)
        rows = self.spark.table(self.table)
        return rows.where(F.col("run") < before) if before is not None else rows

    def drop_seen(self, rows: DataFrame, before: str | None = None, few: int = FEW) -> DataFrame:
        """Rows whose ``hashed_url`` no part (named before ``before``) holds. ``rows`` should
        be a stored table: up to ``few`` fingerprints are looked at first, so that only the
        buckets they fall into are read."""
        seen = self.read(before).select("hashed_url")
        met = rows.select("hashed_url").where("hashed_url is not null").distinct().limit(few + 1).collect()
        if len(met) <= few:
            seen = seen.where(F.col("hashed_url").isin([r[0] for r in met]))
        return rows.join(seen, "hashed_url", "left_anti").select(*rows.columns)

    def merge(self, upto: str) -> None:
        """Make one part of all parts up to the run ``upto``; repeated fingerprints become
        one. If it breaks off before the old parts are gone, some fingerprints are held
        twice, which changes no lookup."""
        old = [r for r in self.runs() if r.partition(_MERGED)[0] <= upto]
        if len(old) < 2:
            return
        parts = [f"{self.path}/run={run}" for run in old]
        rows = self.spark.read.schema("hashed_url string, url string").parquet(*parts)
        kept = rows.groupBy("hashed_url").agg(F.min("url").alias("url"))
        self.append(kept, f"{upto}{_MERGED}{uuid.uuid4().hex}")
        for run in old:
            remove(self.spark, f"{self.path}/run={run}")
