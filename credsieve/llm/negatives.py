"""Hard-negative mining: exact integer scores from products of packed components."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from credsieve.llm.common import read, written

SCALE = 256
POSITIVES = 5
NEGATIVES = 10
#: A negative scores between these shares (in percent) of the positive's score.
LOW, HIGH = 30, 90
#: Anchors that one pass over the table serves: what a task holds of them is bounded.
ANCHOR_BLOCK = 4096
#: Scores that a task holds at a time.
CELLS = 1 << 21
#: Components beyond this are set to it, so that scores of up to 2**8 components fit a long.
LARGEST = 1 << 27
#: Integers below 2**53 are exact in a double, whose matrix product is the fastest.
WIDE_BITS = 53
#: Below every score.
WORST = np.iinfo(np.int64).min
RESULT = (
    "anchor_id long, positive_id long, rank int, negative_id long, positive_score long,"
    " negative_score long"
)


def quantised(rows: DataFrame, vector: str, scale: int) -> DataFrame:
    """``rows`` whose vector has no null or non-finite component, with ``floor(scale * x)``
    of every component x in place of the vector (array of long)."""

    def whole(x):
        low = F.greatest(F.floor(x.cast("double") * scale), F.lit(-LARGEST).cast("long"))
        return F.least(low, F.lit(LARGEST).cast("long"))

    def usable(x):
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    good = F.col(vector).isNotNull() & F.forall(vector, usable)
    return rows.where(good).withColumn(vector, F.transform(vector, whole))


def matrix(column: pd.Series, width: int) -> np.ndarray:
    """Vectors as the rows of a matrix of ``width`` columns, filled up with zeros."""
    if len(column) and all(len(vector) == width for vector in column):
        return np.concatenate(list(column)).astype(np.int64).reshape(len(column), width)
    out = np.zeros((len(column), width), np.int64)
    for k, vector in enumerate(column):
        out[k, : len(vector)] = vector[:width]
    return out


def inner_products(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of two integer matrices, anchors by candidates.

    Components are biased to be no less than 0, and those of several candidates are laid
    side by side as fields of one wide integer, each as wide as the largest sum can get.
    One product with an anchor component then serves all fields at once; no field can
    run over into the next. The sums are unpacked and the biases taken off. If not even
    two fields fit, plain 64 bit products are used.
    """
    n, width = candidates.shape
    if n == 0 or len(anchors) == 0 or width == 0:
        return np.zeros((len(anchors), n), np.int64)
    bias = max(-int(candidates.min()), 0)
    anchor_bias = max(-int(anchors.min()), 0)
    largest = width * (int(candidates.max()) + bias) * (int(anchors.max()) + anchor_bias)
    bits = max(largest.bit_length(), 1)
    fields = min(WIDE_BITS // bits, n)
    if fields < 2:
        return anchors @ candidates.T
    lots = -(-n // fields)
    biased = np.zeros((lots * fields, width), np.int64)
    biased[:n] = candidates + bias
    packed = np.zeros((lots, width), np.int64)
    for f in range(fields):
        packed |= biased[f * lots : (f + 1) * lots] << (f * bits)
    wide = (anchors + anchor_bias).astype(np.float64) @ packed.T.astype(np.float64)
    wide = wide.astype(np.int64)
    out = np.empty((len(anchors), lots * fields), np.int64)
    for f in range(fields):
        out[:, f * lots : (f + 1) * lots] = (wide >> (f * bits)) & ((1 << bits) - 1)
    # (a + anchor_bias) * (c + bias) = a * c + bias * a + anchor_bias * (c + bias)
    out = out[:, :n]
    out -= bias * anchors.sum(axis=1)[:, None]
    out -= anchor_bias * biased[:n].sum(axis=1)
    return out


class Anchors:
    """A block of anchors: ids, labels and components as arrays."""

    def __init__(self, rows, width):
        self.id = np.array([r.id for r in rows], np.int64)
        self.label = np.array([r.label for r in rows], np.int64)
        self.x = matrix([r.x for r in rows], width)
        #: The positives of each anchor by rank, known after the first pass.
        self.positive_id = self.positive_score = np.zeros((len(rows), 0), np.int64)
        self.known = np.zeros((len(rows), 0), bool)

    def set_positives(self, rows):
        shape = (len(self.id), max((r["rank"] for r in rows), default=0))
        self.positive_id, self.positive_score = np.zeros(shape, np.int64), np.zeros(shape, np.int64)
        self.known = np.zeros(shape, bool)
        for r in rows:
            at = (r["group"], r["rank"] - 1)
            self.positive_id[at], self.positive_score[at] = r["id"], r["score"]
            self.known[at] = True


class Best:
    """The ``keep`` best (score, id) of each group so far, higher scores first, ties by
    smaller id; pairs that occur twice count once."""

    def __init__(self, groups: int, keep: int):
        self.keep = keep
        self.group = self.score = self.id = np.zeros(0, np.int64)
        #: What a score must reach to get in.
        self.least = np.full(groups, WORST)

    def add(self, groups, scores, allowed, ids):
        """Take the allowed cells of a matrix of scores, whose rows are ``groups`` and
        whose columns ``ids``."""
        allowed &= scores >= self.least[groups][:, None]
        if len(ids) > 4 * self.keep and len(np.unique(ids)) == len(ids):
            fits = np.where(allowed, scores, WORST)
            low = np.partition(fits, -self.keep, axis=1)[:, -self.keep]
            allowed &= scores >= low[:, None]
        row, column = np.nonzero(allowed)
        group = np.concatenate((self.group, groups[row]))
        score = np.concatenate((self.score, scores[row, column]))
        id_ = np.concatenate((self.id, ids[column]))
        order = np.lexsort((id_, -score, group))
        group, score, id_ = group[order], score[order], id_[order]
        new = np.ones(len(group), bool)
        new[1:] = (np.diff(group) != 0) | (np.diff(score) != 0) | (np.diff(id_) != 0)
        group, score, id_ = group[new], score[new], id_[new]
        rank = np.arange(len(group)) - np.searchsorted(group, group)
        kept = rank < self.keep
        self.group, self.score, self.id = group[kept], score[kept], id_[kept]
        last = rank == self.keep - 1
        self.least[group[last]] = score[last]

    def frame(self):
        return pd.DataFrame({"group": self.group, "score": self.score, "id": self.id})


def _slices(frames, anchors):
    """Candidates, at most as many at a time as have their scores fit into CELLS."""
    step = max(1, CELLS // max(len(anchors.id), 1))
    for frame in frames:
        for k in range(0, len(frame), step):
            part = frame.iloc[k : k + step]
            x = matrix(part["x"], anchors.x.shape[1])
            yield part["id"].to_numpy(np.int64), part["label"].to_numpy(np.int64), x


def _positives(anchors, keep):
    """Task that gives the best ``keep`` of its rows for each anchor, of the same label."""

    def run(frames):
        best = Best(len(anchors.id), keep)
        for ids, label, x in _slices(frames, anchors):
            for value in np.intersect1d(label, anchors.label):
                row, own = np.flatnonzero(label == value), np.flatnonzero(anchors.label == value)
                scores = inner_products(anchors.x[own], x[row])
                best.add(own, scores, anchors.id[own][:, None] != ids[row], ids[row])
        yield best.frame()

    return run


def _negatives(anchors, keep, low, high):
    """Task that gives, for each anchor and positive, the best ``keep`` of its rows that
    have another label and score between the bounds."""
    floor = -(-low * anchors.positive_score // 100)
    ceiling = high * anchors.positive_score // 100
    places = anchors.known.shape[1]

    def run(frames):
        best = Best(len(anchors.id) * places, keep)
        for ids, label, x in _slices(frames, anchors):
            scores = inner_products(anchors.x, x)
            other = (anchors.label[:, None] != label) & (anchors.id[:, None] != ids)
            for p in range(places):
                fits = (scores >= floor[:, p][:, None]) & (scores <= ceiling[:, p][:, None])
                fits &= other & anchors.known[:, p][:, None]
                best.add(np.arange(len(anchors.id)) * places + p, scores, fits, ids)
        out = best.frame()
        # Whole rows of the result; the rank follows when all tasks' rows are together.
        at = (out["group"] // max(places, 1), out["group"] % max(places, 1))
        out["anchor_id"] = anchors.id[at[0]]
        out["positive_id"] = anchors.positive_id[at]
        out["positive_score"] = anchors.positive_score[at]
        yield out

    return run


def _first(rows, keep):
    """The ``keep`` first different (score, id) of each group and their rank; Spark cuts
    each task's rows to as many before they are shuffled."""
    order = Window.partitionBy("group").orderBy(F.desc("score"), "id")
    ranked = rows.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= keep)
    return ranked.dropDuplicates(["group", "rank"])


def hard_negatives(
    rows: DataFrame,
    is_anchor,
    id_column: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    scale: int = SCALE,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    block: int = ANCHOR_BLOCK,
) -> DataFrame:
    """For each anchor and each of its ``positives`` best rows of the same label, the best
    ``negatives`` rows of another label that score between ``low`` and ``high`` percent
    of the positive's score: anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score (all long but rank).

    ``is_anchor`` is a condition on ``rows``. A score is the inner product of the vectors'
    components, quantised to ``floor(scale * x)`` (within 2**27 on either side); higher
    scores come first, ties by smaller id. Every anchor is scored against every row, in
    blocks of anchors: a block (``block`` rows at most) goes to all tasks, the rows stay
    where they were read. A first pass finds the positives, a second the negatives.

    Rows with a null label, id or vector or with a null or non-finite component take no
    part. Rows of one id are never partners of each other; rows that repeat an id count
    once for an anchor if they have one label and score. Shorter vectors count as filled up with zeros. Without anchors
    or partners the result is empty. Other columns of ``rows`` are not read.
    """
    spark = rows.sparkSession
    own = rows.where(F.col(id_column).isNotNull() & F.col(label).isNotNull())
    own = own.select(
        F.col(id_column).cast("long").alias("id"),
        F.col(label).cast("long").alias("label"),
        F.col(vector).alias("x"),
        F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
    )
    own = quantised(own, "x", scale)
    chosen = written(own.where("anchor").select("id", "label", "x").distinct(), "anchors")
    total, width = chosen.agg(F.count("*"), F.max(F.size("x"))).first()
    # Blocks by hash, on average so far below the bound that hardly one exceeds it.
    blocks = 1 if total <= block else -(-total // max(block - 4 * math.isqrt(block), 1))
    chosen = chosen.withColumn("block", F.pmod(F.xxhash64("id", "label", "x"), F.lit(blocks)))
    candidates = own.select("id", "label", "x")
    paths = []
    for k in range(blocks):
        members = chosen.where(F.col("block") == k).orderBy("id", "label", "x").collect()
        for m in range(0, len(members), block):
            anchors = Anchors(members[m : m + block], width)
            mined = _mine(candidates, anchors, positives, negatives, low, high)
            paths.append(written(mined, "negatives").scratch_path)
    if not paths:
        return spark.createDataFrame([], RESULT)
    return spark.read.schema(RESULT).parquet(*paths)


def _mine(candidates, anchors, positives, negatives, low, high):
    """Rows of the result for one block of anchors."""
    schema = "group long, score long, id long"
    best = candidates.mapInPandas(_positives(anchors, positives), schema)
    anchors.set_positives(_first(best, positives).collect())
    schema += ", anchor_id long, positive_id long, positive_score long"
    pairs = candidates.mapInPandas(_negatives(anchors, negatives, low, high), schema)
    return _first(pairs, negatives).select(
        "anchor_id",
        "positive_id",
        "rank",
        F.col("id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )


def moved_labels(rows: DataFrame) -> DataFrame:
    """``rows`` with label (label + 1) % 10 where vec_id is divisible by 7."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rows.select("vec_id", "embedding", moved.alias("label"))


def op11_hard_negatives(spark, sf_dir):
    rows = moved_labels(read(spark, sf_dir, "embeddings"))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


ORACLE = """
WITH kept AS (
  SELECT vec_id,
         CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM kept a JOIN kept b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
ranked AS (
  SELECT p.anchor_id, p.positive_id,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id
                            ORDER BY n.score DESC, n.other_id) AS rank,
         n.other_id AS negative_id, p.positive_score, n.score AS negative_score
  FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
   AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score,
       negative_score
FROM ranked WHERE rank <= 10
"""
