"""Helpers shared by the operators: tables, scratch, vectorised words, components."""

import gc
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"

#: The bytes that separate words: space and \t \n \v \f \r.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
WORD = r"[^\x20\x09-\x0D]+"

_local: dict = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by the session; one of this process's own only if
    none is named and the session runs in one process, as in tests."""
    path = spark.conf.get(CHECKPOINT_CONF, None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder all executors share")
    return _local.setdefault("dir", tempfile.mkdtemp(prefix="credsieve-llm-"))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: computed once,
    cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/credsieve-llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` over all shuffle partitions, for few rows that each take long; Spark would
    put them into few tasks by their size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def discard(*tables: DataFrame) -> None:
    """Remove tables made by ``written`` that nothing reads any more, and let Spark drop
    the shuffle files of finished jobs (it does so once their plans are garbage)."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.scratch_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    release(spark)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished jobs before a large step."""
    gc.collect()
    spark._jvm.System.gc()


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet, whatever its extra columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keyed(docs: DataFrame, id_column: str = "doc_id") -> tuple[DataFrame, list[str]]:
    """``docs`` plus two key columns (96 bits) made of id and whole text, and their names.

    Rows equal in both share a key, so nothing has to number the rows; nulls count
    as values of their own.
    """
    k1, k2 = fresh(docs, "_key1"), fresh(docs, "_key2")
    null = F.col("text").isNull()
    return docs.withColumns(
        {
            k1: F.xxhash64(F.col(id_column), null, F.col("text")),
            k2: F.hash(F.col("text"), null, F.col(id_column)),
        }
    ), [k1, k2]


#: Bits of the filters of keys: 4 MB, whatever the number of keys. With 1.6 million keys one
#: other row in 20 passes in vain.
FILTER_BITS = 1 << 25


def key_bitmaps(hashes: DataFrame) -> DataFrame:
    """A filter of the hashes in the only column of ``hashes`` (long): bitmaps of
    ``FILTER_BITS`` bits in all, small enough to be broadcast at any size of the input."""
    place = F.pmod(F.col(hashes.columns[0]), F.lit(FILTER_BITS))
    return hashes.groupBy(F.call_function("bitmap_bucket_number", place).alias("bucket")).agg(
        F.call_function("bitmap_construct_agg", F.call_function("bitmap_bit_position", place)).alias("bitmap")
    )


def with_likely(rows: DataFrame, hashed, bitmaps: DataFrame, name: str) -> DataFrame:
    """``rows`` plus a column ``name``: false where the hash ``hashed`` is surely not among
    those of ``bitmaps``. Rows stay where they are."""
    bucket, position, bitmap = (fresh(rows, f"_{c}") for c in ("bucket", "position", "bitmap"))
    place = F.pmod(hashed, F.lit(FILTER_BITS))
    placed = rows.withColumns(
        {
            bucket: F.call_function("bitmap_bucket_number", place),
            position: F.call_function("bitmap_bit_position", place).cast("int"),
        }
    )
    filters = F.broadcast(bitmaps.select(F.col("bucket").alias(bucket), F.col("bitmap").alias(bitmap)))
    at = F.col(position)
    byte = F.conv(F.hex(F.substring(F.col(bitmap), (at / 8).cast("int") + 1, F.lit(1))), 16, 10)
    holds = F.call_function("shiftright", byte.cast("int"), at % 8) % 2 == 1
    joined = placed.join(filters, bucket, "left").withColumn(name, F.coalesce(holds, F.lit(False)))
    return joined.drop(bucket, position, bitmap)


def labelled_texts(docs: DataFrame, chosen: DataFrame, label: str = "quality") -> DataFrame:
    """One text for each of the chosen doc_ids, whose number is fixed; of several rows
    with one id the smallest text, combined before the shuffle."""
    return (
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen.select("doc_id", label)), "doc_id")
        .groupBy("doc_id")
        .agg(F.min("text").alias("text"), F.first(label).alias(label))
        .where("text is not null")
    )


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (u, v: long) as rows (node, component).

    Alternates large-star and small-star steps until the edges no longer change;
    the component is the smallest node. Every step is a minimum per node, combined
    before the shuffle, and a join back, so a node with many edges is never
    gathered anywhere. The number of rounds is logarithmic in practice. Nodes
    without an edge to another node are not returned.
    """
    now = written(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .where("u <> v")
        .distinct(),
        "edges",
    )
    state = _edge_state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.join(low, "u")
            .where("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        large = written(
            large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
            "large-star",
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"),
            F.col("m").alias("v"),
        )
        # The node itself joins its minimum too, also when all its edges move on.
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = written(small, "small-star")
        after = _edge_state(now)
        if after == state:
            break
        state = after
    top = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(top)


def _edge_state(edges: DataFrame):
    row = edges.agg(
        F.count("*").alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
    ).first()
    return row.n, row.h


# ---- words of many texts at once, as numpy arrays ---------------------------------

_SEED = np.random.RandomState(20240607)
_VALUES = _SEED.randint(0, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
#: Every ASCII byte that is neither letter nor digit.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_powers: dict = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 20)
        have = np.ones(size, np.uint64)
        have[1:] = np.uint64(base)
        have = np.multiply.accumulate(have)
        _powers[base] = have
    return have[:n]


def running_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``span_hash`` gives the hash of any byte range."""
    return np.concatenate(
        (np.zeros(1, np.uint64), np.cumsum(_VALUES[data] * powers(_BASE, len(data))))
    )


def span_hash(running: np.ndarray, start, end) -> np.ndarray:
    """Hashes of the byte ranges [start, end); equal bytes have equal hashes."""
    return mix((running[end] - running[start]) * powers(_BASE_INVERSE, len(running))[start])


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def batches(texts, limit=1 << 20):
    """Split texts (bytes) into runs of about ``limit`` bytes; a longer text is a run
    of its own. Yields (first index, list)."""
    run, size, first = [], 0, 0
    for i, t in enumerate(texts):
        if run and size + len(t) > limit:
            yield first, run
            run, size, first = [], 0, i
        run.append(t)
        size += len(t) + 1
    if run:
        yield first, run


class Words:
    """Words of a list of texts (bytes): ``start`` and ``end`` in ``data``, 64-bit
    ``hash``, ``doc`` (index of the text) of every word, ``first`` (index of the first
    word of each text, one more entry at the end) and ``offset`` of each text. Words are
    runs of bytes that ``separators`` does not mark; newlines always separate."""

    def __init__(self, texts, separators=_IS_SPACE):
        self.data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.size = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.offset = np.concatenate(([0], np.cumsum(self.size + 1)))[:-1]
        space = separators[self.data]
        self.space = space
        edge = np.diff(np.concatenate(([True], space)).astype(np.int8))
        self.start = np.flatnonzero(edge == -1)
        self.end = np.flatnonzero(edge == 1)
        self.hash = span_hash(running_hash(self.data), self.start, self.end)
        self.first = np.searchsorted(self.start, np.append(self.offset, len(self.data)))
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def grams(self, n):
        """Hashes of all n-word windows inside one text, and the first word of each."""
        if len(self.start) < n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.doc[n - 1 :] == self.doc[: len(self.doc) - n + 1])
        h = self.hash[at]
        for k in range(1, n):
            h = mix(h * np.uint64(0xD6E8FEB86659FD93) + self.hash[at + k])
        return h, at

    def per_text(self, marks):
        """Sum of ``marks`` (one number per byte) for each text."""
        total = np.concatenate(([0], np.cumsum(marks, dtype=np.int64)))
        return total[self.offset + self.size] - total[self.offset]
