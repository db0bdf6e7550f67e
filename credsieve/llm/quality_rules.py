"""Quality rules: counted text features and a hashed n-gram log-likelihood ratio."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credsieve.llm.common import SPACES, Words, batches, key_bitmaps, mix, read, with_likely

#: Hash buckets of words and word pairs; the two models are vectors of this length.
BUCKETS = 1 << 16
#: Counts added to every bucket of either model, as a share of the mean bucket count.
SMOOTHING = 3.0
#: N-grams of ratio zero added to every text, so that a few words decide nothing.
PRIOR_GRAMS = 16
#: Texts whose mean log ratio is lower are dropped (nats per n-gram).
THRESHOLD = -0.04
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
SYMBOLS = b"#*$%&|<>"

_BLANK = bytes(SPACES).decode()


def gram_buckets(words: Words):
    """Buckets of all words and word pairs, and the text each belongs to."""
    pairs, at = words.grams(2)
    hashes = np.concatenate((words.hash, pairs))
    texts = np.concatenate((words.doc, words.doc[at]))
    return (hashes >> np.uint64(64 - (BUCKETS.bit_length() - 1))).astype(np.int64), texts


def _texts(frame):
    return [t.encode() if t is not None else b"" for t in frame["text"]]


def trusted_rows(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """Text of the rows of ``docs`` whose doc_id is in ``trusted``, which may have as many
    rows as ``docs``.

    A filter of the trusted ids, of fixed size, is broadcast. Rows that it does not hold
    stay where they are; the few others that are not trusted go in the join that decides.
    """
    ids = trusted.select("doc_id").where("doc_id is not null").distinct()
    hashed = F.xxhash64(F.col("doc_id").cast("string"))
    rows = with_likely(docs.select("doc_id", "text"), hashed, key_bitmaps(ids.select(hashed)), "_likely")
    # Not a semi join, which the optimizer would put before the filter.
    return rows.where("_likely").join(ids.hint("merge"), "doc_id").select("text")


def _counted(texts: DataFrame, name: str) -> DataFrame:
    """(bucket, ``name``): n-grams of all texts; every task adds up its rows before the
    counts are shuffled."""

    def run(frames):
        total = np.zeros(BUCKETS, np.int64)
        for frame in frames:
            for _, part in batches(_texts(frame)):
                total += np.bincount(gram_buckets(Words(part))[0], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, name: total[at]})

    return texts.select("text").mapInPandas(run, f"bucket long, {name} long")


def gram_counts(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(bucket, raw, target): n-grams of all rows, and of rows whose doc_id is in
    ``trusted``. All rows are counted where they are read; only trusted ones are moved."""
    raw = _counted(docs, "raw").withColumn("target", F.lit(0).cast("long"))
    target = _counted(trusted_rows(docs, trusted), "target").withColumn("raw", F.lit(0).cast("long"))
    both = raw.unionByName(target).groupBy("bucket")
    return both.agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: DataFrame) -> np.ndarray:
    """Log of target over raw probability of every bucket. ``BUCKETS`` rows reach the
    driver, however large the corpus. Without any trusted text all ratios are zero."""
    rows = counts.toPandas()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[rows["bucket"]] = rows["raw"]
    target[rows["bucket"]] = rows["target"]
    if not target.sum():
        return np.zeros(BUCKETS)

    def log_model(n):
        n = n + SMOOTHING * n.sum() / BUCKETS
        return np.log(n / n.sum())

    return log_model(target) - log_model(raw)


def text_features(texts, ratios) -> dict:
    """Columns of the contract (without the verdict) and ``llr`` for texts (bytes)."""
    words = Words(texts)
    n = np.diff(words.first)
    letters = ((words.data & 0xC0) != 0x80) & ~words.space
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    buckets, doc = gram_buckets(words)
    total = np.bincount(doc, ratios[buckets], minlength=len(texts))
    grams = np.bincount(doc, minlength=len(texts))
    return {
        "n_words": n,
        "word_chars": words.per_text(letters),
        "n_symbols": words.per_text(symbol[words.data]),
        "n_dup_lines": np.array([_repeated_lines(t.decode()) for t in texts], np.int64),
        "n_repeat_words": _repeated_words(words),
        "llr": total / (grams + PRIOR_GRAMS),
    }


def _repeated_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(_BLANK)]
    return len(lines) - len(set(lines))


def _repeated_words(words: Words) -> np.ndarray:
    """Words of each text in a window of ``WINDOW`` words that the text holds twice."""
    h, at = words.grams(WINDOW)
    h = h ^ mix(words.doc[at].astype(np.uint64) + np.uint64(1))
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words.start) + 1, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + WINDOW, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return np.bincount(words.doc[covered], minlength=len(words.size)).astype(np.int64)


def judge_texts(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, the counts, llr, base_failed, kept.

    ``llr`` is the mean log-likelihood ratio of the text's words and word pairs between
    the texts of ``trusted`` (doc_id) and all texts; a text is kept if the base rules
    hold and ``llr`` reaches ``threshold``. A null text counts as empty: no words,
    base rules failed. Repeated rows come out as often as they occur, extra columns
    are ignored, null doc_ids are judged but never trusted, an empty table gives an
    empty result; without trusted texts the base rules alone decide.
    """
    ratios = log_ratios(gram_counts(docs, trusted))

    def run(frames):
        for frame in frames:
            parts = [pd.DataFrame(text_features(t, ratios)) for _, t in batches(_texts(frame))]
            if parts:
                out = pd.concat(parts, ignore_index=True)
                out.insert(0, "doc_id", frame["doc_id"].reset_index(drop=True))
                yield out

    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = ", ".join([f"doc_id {kind}", *[f"{c} long" for c in counts], "llr double"])
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    return (
        docs.select("doc_id", "text")
        .mapInPandas(run, schema)
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
    )


def op5_quality_rules(spark, sf_dir):
    trusted = read(spark, sf_dir, "labels").where("quality = 1")
    return judge_texts(read(spark, sf_dir, "documents"), trusted)
