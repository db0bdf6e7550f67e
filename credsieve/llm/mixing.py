"""Mixing to target weights: domain posteriors, then rates by projected gradient.

A classifier fitted on the labelled table gives every document its domain posteriors p
(soft membership). Rates r >= 0 are then fitted so that the expected token totals
sum(r * tokens * p) match the targets: least squares, minimised by projected gradient
from r = 1. A step moves every rate by its posteriors' product with one vector of a few
numbers, the weighted residual, and cuts it off at zero; that vector is all that the
driver gathers, so the steps of a fit are a short list from which any task can compute
its documents' rates.
"""

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credsieve.llm.common import Words, batches, labelled_texts, read, written

#: Hash buckets of words, whose presence is the classifier's input.
BUCKETS = 1 << 15
#: Labelled texts per domain that the classifier is fitted on, in the order of a hash
#: of the doc_id; domains are weighted by their share of all labelled rows.
TEXTS_PER_DOMAIN = 1500
MAX_DOMAINS = 64
FIT_STEPS = 300
RIDGE = 1e-4
#: Projected gradient: steps at most, and the largest error of a domain's total, as a
#: share of all tokens, at which it stops.
MAX_STEPS = 60
TOLERANCE = 1e-5
#: Target shares of all tokens by (quality, toxic) of the registered query.
TARGETS = {"1-0": 0.90, "0-0": 0.07, "1-1": 0.02, "0-1": 0.01}


def _texts(frame):
    return [t.encode() if t is not None else b"" for t in frame["text"]]


def word_buckets(texts):
    """(text, bucket) of the distinct word buckets of each text, and its word count."""
    words = Words(texts)
    bucket = (words.hash >> np.uint64(64 - (BUCKETS.bit_length() - 1))).astype(np.int64)
    pairs = np.unique(words.doc * BUCKETS + bucket)
    return pairs // BUCKETS, pairs % BUCKETS, np.diff(words.first)


class DomainModel:
    """Multinomial logistic regression on word presence; a matrix of bounded size."""

    def __init__(self, domains, weights, bias):
        self.domains, self.weights, self.bias = domains, weights, bias

    def posteriors(self, texts):
        text, bucket, tokens = word_buckets(texts)
        scores = np.column_stack(
            [np.bincount(text, w[bucket], minlength=len(texts)) for w in self.weights]
        )
        return softmax(scores + self.bias), tokens

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, column: str) -> "DomainModel":
        """Fit on the rows of ``labels`` (doc_id and the domain's name in ``column``) whose
        documents are in ``docs``, so that the sample and the domains' shares are those of
        the documents to be mixed; a doc_id with several domains, or null ones, is left out."""
        present = docs.select("doc_id").distinct().hint("merge")
        known = (
            labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull())
            .join(present, "doc_id", "left_semi")
            .groupBy("doc_id")
            .agg(F.min(column).alias("domain"), F.max(column).alias("high"))
            .where("domain = high")
            .select("doc_id", "domain", F.xxhash64("doc_id", F.lit("mixing")).alias("order"))
        )
        sizes = dict(known.groupBy("domain").count().limit(MAX_DOMAINS + 1).collect())
        if len(sizes) > MAX_DOMAINS:
            raise ValueError(f"more than {MAX_DOMAINS} domains")
        domains = sorted(sizes)
        if not domains:
            return cls(["all"], np.zeros((1, BUCKETS)), np.zeros(1))
        chosen = None
        for name in domains:
            own = known.where(F.col("domain") == name).orderBy("order", "doc_id")
            own = own.limit(TEXTS_PER_DOMAIN)
            chosen = own if chosen is None else chosen.unionByName(own)

        def run(frames):
            for frame in frames:
                text, bucket, _ = word_buckets(_texts(frame))
                cut = np.searchsorted(text, np.arange(1, len(frame)))
                yield pd.DataFrame(
                    {
                        "doc_id": frame["doc_id"].astype(str),
                        "domain": frame["domain"],
                        "words": np.split(bucket, cut),
                    }
                )

        used = labelled_texts(docs, chosen, "domain")
        rows = used.mapInPandas(run, "doc_id string, domain string, words array<long>").toPandas()
        rows = rows.sort_values("doc_id")
        return cls(domains, *fit_logistic(rows, domains, sizes))


def softmax(scores):
    e = np.exp(scores - scores.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit_logistic(rows, domains, sizes):
    """Weights and bias by gradient steps with momentum and per-weight step sizes."""
    k = len(domains)
    weights, bias = np.zeros((k, BUCKETS)), np.zeros(k)
    if not len(rows):
        return weights, bias
    y = np.searchsorted(domains, rows["domain"])
    text = np.repeat(np.arange(len(rows)), rows["words"].map(len))
    bucket = np.concatenate([np.asarray(w, np.int64) for w in rows["words"]])
    drawn = np.bincount(y, minlength=k)
    share = np.array([sizes[d] for d in domains]) / sum(sizes.values())
    weight = (share / np.maximum(drawn, 1))[y]
    weight /= weight.sum()
    wanted = np.eye(k)[y]
    state = [np.zeros((k, BUCKETS)), np.zeros((k, BUCKETS)), np.zeros(k), np.zeros(k)]
    for step in range(1, FIT_STEPS + 1):
        scores = np.column_stack([np.bincount(text, w[bucket], minlength=len(rows)) for w in weights])
        error = (softmax(scores + bias) - wanted) * weight[:, None]
        slope = np.stack([np.bincount(bucket, e[text], minlength=BUCKETS) for e in error.T])
        slope += RIDGE * weights
        for value, gradient, at in ((weights, slope, 0), (bias, error.sum(0), 2)):
            state[at] = 0.9 * state[at] + 0.1 * gradient
            state[at + 1] = 0.99 * state[at + 1] + 0.01 * gradient**2
            mean, square = state[at] / (1 - 0.9**step), state[at + 1] / (1 - 0.99**step)
            value -= 0.02 * mean / (np.sqrt(square) + 1e-8)
    return weights, bias


def memberships(docs: DataFrame, model: DomainModel, keep) -> DataFrame:
    """Columns ``keep`` of every row, tokens (words of the whole text), posteriors."""
    keep = list(keep)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames):
        for frame in frames:
            for first, texts in batches(_texts(frame)):
                posteriors, tokens = sent.value.posteriors(texts)
                out = frame[keep].iloc[first : first + len(texts)].copy()
                out["tokens"] = tokens
                out["posteriors"] = list(posteriors)
                yield out

    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    schema = ", ".join([*kinds, "tokens long", "posteriors array<double>"])
    return docs.select(*keep, "text").mapInPandas(run, schema)


def replay(posteriors: np.ndarray, steps) -> np.ndarray:
    """Rates after the given steps, from rate 1."""
    rates = np.ones(len(posteriors))
    for step in steps:
        rates = np.maximum(rates - posteriors @ step, 0.0)
    return rates


def _totals(members: DataFrame, steps, k: int):
    """Expected tokens per domain at the rates of ``steps``, and the tokens' moments."""

    def run(frames):
        total, moments = np.zeros(k), np.zeros((k, k))
        for frame in frames:
            if not len(frame):
                continue
            p, n = np.stack(frame["posteriors"]), frame["tokens"].to_numpy()
            total += (replay(p, steps) * n) @ p
            if not steps:
                moments += (p * n[:, None]).T @ p
        yield pd.DataFrame({"at": np.arange(k * (k + 1)), "x": np.append(total, moments)})

    parts = members.select("tokens", "posteriors").mapInPandas(run, "at int, x double")
    rows = parts.groupBy("at").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(k * (k + 1))
    for row in rows:
        out[row["at"]] = row["x"]
    return out[:k], out[k:].reshape(k, k)


def fit_rates(members: DataFrame, domains, targets: dict) -> tuple[list, np.ndarray]:
    """Steps of the projected gradient and the final error of each domain's share.

    The residuals are weighted by the inverse of the tokens' second moments, and rates
    by their tokens; in that metric the curvature is at most 1, so steps of length 1
    never increase the error. Targets are shares of all tokens, scaled to sum to 1 over
    the domains that exist. Targets out of reach (a domain without documents) are
    approached as far as they can be.
    """
    wanted = np.array([max(targets.get(d, 0.0), 0.0) for d in domains])
    wanted = wanted / wanted.sum() if wanted.sum() else np.full(len(domains), 1 / len(domains))
    steps: list = []
    total, moments = _totals(members, steps, len(domains))
    tokens = total.sum()
    if not tokens:
        return steps, np.zeros(len(domains))
    inverse = np.linalg.pinv(moments / tokens + 1e-9 * np.eye(len(domains)), hermitian=True)
    while True:
        error = total / tokens - wanted
        if np.abs(error).max() <= TOLERANCE or len(steps) == MAX_STEPS:
            return steps, error
        steps.append(inverse @ error)
        total, _ = _totals(members, steps, len(domains))


def mix(docs: DataFrame, labels: DataFrame, column: str, targets: dict) -> DataFrame:
    """One row per row of ``docs``: doc_id, tokens, domain, posteriors, rate, copies, error.

    ``error`` is the same in all rows: the largest difference, over the domains, between
    the share of the tokens that the rates give a domain and its target. Beyond
    ``TOLERANCE`` the targets were out of reach (a domain without documents, say) or the
    steps too few, and a warning says which domains miss theirs. ``posteriors`` follow the domains in sorted order, ``domain`` is the likeliest (the
    first of equals), ``rate`` the fitted number of uses, ``copies`` an integer draw with
    that mean, fixed by a hash of the doc_id. A null or blank text has no tokens, so its
    rate moves no total. Rows that occur twice are documents of their own, extra columns
    are ignored, an empty table gives an empty result; without labels there is one
    domain, ``all``.
    """
    model = DomainModel.fit(docs, labels, column)
    members = written(memberships(docs, model, ["doc_id"]), "mixing-members")
    steps, error = fit_rates(members, model.domains, targets)
    domains = model.domains
    missed = {d: round(float(e), 6) for d, e in zip(domains, error) if abs(e) > TOLERANCE}
    # Targets for domains that no label names can have no documents either.
    missed |= {d: -t for d, t in targets.items() if t > 0 and d not in domains}
    if missed:
        warnings.warn(f"shares of all tokens that miss their targets, by domain: {missed}", stacklevel=2)
    worst = max([abs(float(e)) for e in error] + [abs(e) for e in missed.values()], default=0.0)

    @F.pandas_udf("double")
    def rate(posteriors: pd.Series) -> pd.Series:
        return pd.Series(replay(np.stack(posteriors), steps) if len(posteriors) else [])

    uniform = F.pmod(F.xxhash64("doc_id", F.lit("copies")), F.lit(1 << 30)) / (1 << 30)
    best = F.array_position("posteriors", F.array_max("posteriors")).cast("int")
    return members.withColumn("rate", rate("posteriors")).select(
        "doc_id",
        "tokens",
        F.element_at(F.array(*[F.lit(d) for d in domains]), best).alias("domain"),
        "posteriors",
        "rate",
        (F.floor("rate") + (uniform < F.col("rate") - F.floor("rate")).cast("long")).alias("copies"),
        F.lit(worst).alias("error"),
    )


def quality_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) with the domain ``quality-toxic``."""
    return labels.select("doc_id", F.expr("quality || '-' || toxic").alias("domain"))


def op4_mixing_to_targets(spark, sf_dir):
    labels = quality_domains(read(spark, sf_dir, "labels"))
    return mix(read(spark, sf_dir, "documents"), labels, "domain", TARGETS)
