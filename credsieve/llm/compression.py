"""Compression classifier: zstandard dictionaries of good and bad text, calibrated."""

import math

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credsieve.llm.common import labelled_texts, read

#: Labelled texts per class for the dictionaries, and the pieces taken of each: the
#: bound of the training sample. Pieces are spread evenly over the whole text.
DICTIONARY_TEXTS = 400
PIECES_PER_TEXT = 32
#: Further labelled texts, in their natural shares, that calibrate the score.
CALIBRATION_TEXTS = 4000
DICTIONARY_BYTES = 112_640
LEVEL = 1
#: Texts are compressed whole, piece by piece, so that the dictionary counts throughout.
PIECE = 1024
#: Bytes added to a text's length when the size difference is normalised.
PRIOR_BYTES = 200
#: Slope of the score without labelled texts to calibrate on.
DEFAULT_SLOPE = 100.0
THRESHOLD = 0.3


def pieces(text: bytes) -> list[bytes]:
    return [text[k : k + PIECE] for k in range(0, len(text), PIECE)]


def build_dictionary(samples: list[bytes]):
    """A zstandard dictionary; the raw samples if they are too few to train on, None
    without samples."""
    if not samples:
        return None
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def _compressor(dictionary):
    data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(
        level=LEVEL,
        dict_data=data,
        write_content_size=False,
        write_checksum=False,
        write_dict_id=False,
    )


def size_differences(texts, good, bad) -> np.ndarray:
    """(size with the bad dictionary - size with the good one) / (bytes + prior) of
    every whole text; 0 for an empty one."""
    with_good, with_bad = _compressor(good), _compressor(bad)
    out = np.zeros(len(texts))
    for k, text in enumerate(texts):
        difference = sum(
            len(with_bad.compress(p)) - len(with_good.compress(p)) for p in pieces(text)
        )
        out[k] = difference / (len(text) + PRIOR_BYTES)
    return out


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(intercept, slope) of a logistic fit by Newton steps, with a weak prior that
    keeps them finite when the classes separate."""
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return math.log(share / (1 - share)), DEFAULT_SLOPE
    scale = x.std() or 1.0
    design = np.column_stack((np.ones(len(x)), x / scale))
    weight = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ weight, -30, 30)))
        gradient = design.T @ (y - p) - 1e-2 * weight
        curve = (design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        weight += step
        if np.abs(step).max() < 1e-9:
            break
    return float(weight[0]), float(max(weight[1], 0.0) / scale)


def _texts(frame):
    return [t.encode() if t is not None else b"" for t in frame["text"]]


def training_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, quality) of the fold that labels may be learnt from: crc32 of the doc_id
    as text, modulo 5, is not 0. Contradicting or null labels are left out."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    one = labels.where(fold & F.col("quality").isNotNull()).groupBy("doc_id")
    both = one.agg(F.min("quality").alias("quality"), F.max("quality").alias("high"))
    return both.where("quality = high and quality in (0, 1)").select("doc_id", "quality")


class QualityModel:
    """Two dictionaries and the calibration, a few hundred kilobytes; ``fit`` draws a
    bounded sample of labelled texts in the order of a hash of their doc_id."""

    def __init__(self, good, bad, intercept, slope):
        self.good, self.bad, self.intercept, self.slope = good, bad, intercept, slope

    def scores(self, texts) -> np.ndarray:
        x = self.intercept + self.slope * size_differences(texts, self.good, self.bad)
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame) -> "QualityModel":
        order = F.xxhash64(F.col("doc_id"), F.lit("sample"))
        known = training_labels(labels).withColumn("order", order)

        def first(rows, n):
            return rows.orderBy("order", "doc_id").limit(n)

        # At most half of a class goes into its dictionary, so that calibration sees both.
        sizes = dict(known.groupBy("quality").count().collect())
        half = {q: min(DICTIONARY_TEXTS, (sizes.get(q, 0) + 1) // 2) for q in (0, 1)}
        chosen = first(known.where("quality = 1"), half[1]).unionByName(
            first(known.where("quality = 0"), half[0])
        )
        samples = labelled_texts(docs, chosen).mapInPandas(_sample_pieces, "quality int, piece binary")
        rows = samples.collect()
        dictionaries = [
            build_dictionary([bytes(r.piece) for r in rows if r.quality == q]) for q in (1, 0)
        ]
        # Rows used above are not used again, if there are others.
        rest = known.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_anti")
        rest = first(rest, CALIBRATION_TEXTS)
        used = labelled_texts(docs, rest)

        def measure(frames):
            for frame in frames:
                x = size_differences(_texts(frame), *dictionaries)
                yield pd.DataFrame({"quality": frame["quality"], "x": x})

        points = used.mapInPandas(measure, "quality int, x double").toPandas()
        points = points.sort_values(["x", "quality"])
        return cls(*dictionaries, *calibrate(points["x"].to_numpy(), points["quality"].to_numpy()))


def _sample_pieces(frames):
    for frame in frames:
        for quality, text in zip(frame["quality"], _texts(frame)):
            own = pieces(text)
            at = np.unique(np.linspace(0, max(len(own) - 1, 0), PIECES_PER_TEXT).astype(int))
            chosen = [own[k] for k in at if k < len(own)]
            yield pd.DataFrame({"quality": [quality] * len(chosen), "piece": chosen})


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    The score (0 to 1, higher for good text) depends on the whole text alone; a null
    text counts as empty, and an empty one gets the score of size difference 0. Rows
    that occur twice come out twice, extra columns are ignored, an empty table gives an
    empty result. A null doc_id is scored and never held out. Without labels the score
    is the uncalibrated difference around one half.
    """
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    score = _score(QualityModel.fit(docs, labels), F.col("text"))
    return docs.select("doc_id", score.alias("score")).select(
        "doc_id",
        F.coalesce(remainder == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def _score(model: QualityModel, text):
    """Column of scores of a text column."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores([t.encode() if t is not None else b"" for t in texts]))

    return score(text)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` whose text scores ``threshold`` or more, with all their columns."""
    return docs.where(_score(QualityModel.fit(docs, labels), F.col("text")) >= threshold)


def op8_quality_classifier(spark, sf_dir):
    return score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
