"""Spreading work over cores, and joins that fit the size of their sides."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credsieve.scratch import written

SALTS = 32
#: Rows of one key from which on they are spread over tasks.
HOT_ROWS = 100_000
#: Rows, and bytes as ``row_bytes`` counts them, up to which a join side is broadcast.
BROADCAST_ROWS = 2_000_000
BROADCAST_BYTES = 128 << 20
#: What a row costs in a hash table besides its values.
_ROW_COST = 32


def fill_cores(table: DataFrame, key: str, task_rows: int | None = None) -> DataFrame:
    """Spread a plain table scan with fewer partitions than cores over all cores.

    A table of few row groups would leave most cores idle in the body pass. A
    large table has more partitions than cores and is left as it is, so its
    bodies are never shuffled. ``task_rows``: about as many rows a task at most, for
    narrow rows that stand for much more work than their bytes tell; they are counted.
    """
    wanted = table.sparkSession.sparkContext.defaultParallelism
    if task_rows is not None:
        wanted = max(wanted, -(-table.count() // task_rows))
    if table.rdd.getNumPartitions() >= wanted:
        return table
    return table.repartition(wanted, key)


def row_bytes(table: DataFrame):
    """Column: bytes of a row, its values as text plus a fixed cost."""
    own = [F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in table.columns]
    return sum(own, F.lit(_ROW_COST)).cast("long")


def fits_broadcast(table: DataFrame, max_rows=BROADCAST_ROWS) -> bool:
    """Whether a stored table is small enough, in rows and in bytes."""
    size = table.agg(F.count("*").alias("rows"), F.sum(row_bytes(table)).alias("bytes")).first()
    return size.rows <= max_rows and (size.bytes or 0) <= BROADCAST_BYTES


def semi_join(
    big: DataFrame, keys: DataFrame, on, max_rows=BROADCAST_ROWS, task_rows=None
) -> DataFrame:
    """Rows of ``big`` whose key is in the stored table ``keys``.

    Small ``keys`` are broadcast, so ``big`` stays where it is; others are left to
    the optimizer, which shuffles both sides. The rows are the same either way.
    ``task_rows``: about as many keys a task at most if both sides are shuffled, for rows
    that stand for more work than their bytes tell. Spark then neither puts tasks
    together by bytes nor sorts the rows of ``big``. The keys are joined once each, as a
    semi join would be moved below the shuffle.
    """
    if fits_broadcast(keys, max_rows):
        keys = F.broadcast(keys)
    elif task_rows is not None:
        on = [on] if isinstance(on, str) else list(on)
        tasks = max(keys.sparkSession.sparkContext.defaultParallelism, -(-keys.count() // task_rows))
        once = keys.select(*on).repartition(tasks, *on).distinct().hint("shuffle_hash")
        return big.repartition(tasks, *on).join(once, on).select(*big.columns)
    return big.join(keys, on, "left_semi")


def left_join_hot(left: DataFrame, right: DataFrame, keys, max_rows=BROADCAST_ROWS, salts=SALTS):
    """Left join to a stored table with one row per key, where ``left`` may have hot keys.

    The right side is measured: a small one is broadcast, so ``left`` is not
    shuffled at all. Beyond that the keys of ``left`` are counted; those of more than
    ``HOT_ROWS`` rows are spread over ``salts`` tasks, and only their rows of the right
    side are repeated per salt.
    """
    if fits_broadcast(right, max_rows):
        return left.join(F.broadcast(right), keys, "left")
    counted = left.groupBy(*keys).agg(F.count("*").alias("_rows")).where(F.col("_rows") > HOT_ROWS)
    hot = F.broadcast(written(counted.select(*keys, F.lit(True).alias("_hot")), "hot-keys"))
    unmatched = F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False))
    spread = F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int")
    salt = F.when(unmatched | F.col("_hot"), spread).otherwise(0)
    last = F.when(F.col("_hot"), salts - 1).otherwise(0)
    salted = left.join(hot, keys, "left").withColumn("_salt", salt).drop("_hot")
    repeated = right.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), last)))
    return salted.join(repeated.drop("_hot"), [*keys, "_salt"], "left").drop("_salt")
