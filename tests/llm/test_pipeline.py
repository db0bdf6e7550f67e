"""Each stage of the pipeline against a plain version, on what its predecessor kept."""

import random
import re

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from credsieve.llm import compression, mixing, simhash
from credsieve.llm.common import written
from tests.llm.test_filters import prose, smith_waterman
from tests.llm.test_pairs import fingerprint, groups, near, words

STAGES = dict(corpus_pipeline.STAGES)


def good(rng, n):
    return prose(rng, n)


def bad(rng, n):
    return " ".join(rng.choice(["$$", "BUY", "###", "click", "win%%", "0000"]) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Good and bad texts, exact and near copies, copied lines, benchmark passages, nulls."""
    rng, path = random.Random(11), tmp_path_factory.mktemp("pipeline")
    items = [(k, prose(rng, 25)) for k in range(6)] + [(6, None), (7, "")]
    shared = [prose(rng, 12) for _ in range(3)]
    rows = []
    for k in range(120):
        if k % 4 == 3:
            text = bad(rng, 90)
        elif k % 10 == 0:
            text = good(rng, 60) + "\n" + items[k // 10 % 6][1].upper() + "\n" + good(rng, 40)
        elif k % 10 == 1:
            text = good(rng, 50) + "\n" + rng.choice(shared) + rng.choice(["", " zz"]) + "\n" + good(rng, 50)
        else:
            text = "\n".join(good(rng, rng.randrange(20, 60)) for _ in range(3))
        rows.append((k, text))
    # Near copies in all lines, beyond the bound of line dedup, yet of few bits.
    for k in range(120, 140):
        lines = rows[k - 118][1].split("\n")
        rows.append((k, "\n".join(f"aa {line} bb" for line in lines)))
    rows += [rows[2], rows[2], (500, rows[4][1]), (None, good(rng, 50)), (501, None), (502, ""), (503, "\n \n")]
    labels = [(k, 0 if k % 4 == 3 else 1, int(k % 9 == 0)) for k in range(110)] + [(None, 1, 0), (5, None, None)]
    docs = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    tables = {
        "documents": spark.createDataFrame(docs, schema),
        "benchmark": spark.createDataFrame(items, "item_id long, text string"),
        "labels": spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    }
    for name, table in tables.items():
        table.write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.fixture(scope="module")
def passed(spark, folder):
    """The documents before each stage and after the last, by the stage's name."""
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out[name] = docs
        docs = written(stage(spark, docs, folder), name)
    return out | {"end": docs}


def after(passed, name):
    names = [*STAGES, "end"]
    return passed[name], passed[names[names.index(name) + 1]]


def full(frame):
    return sorted(map(repr, map(tuple, frame.collect())))


def plain_score(model, text):
    """The score by whole-text loops over pieces, apart from the operator's code."""
    body, gain = (text or "").encode(), 0
    for at in range(0, len(body), compression.PIECE):
        piece, sizes = body[at : at + compression.PIECE], []
        for own in (model.bad, model.good):
            packer = zstandard.ZstdCompressor(
                level=compression.LEVEL,
                dict_data=zstandard.ZstdCompressionDict(own),
                write_content_size=False,
                write_checksum=False,
                write_dict_id=False,
            )
            sizes.append(len(packer.compress(piece)))
        gain += sizes[0] - sizes[1]
    x = model.intercept + model.slope * gain / (len(body) + compression.PRIOR_BYTES)
    return 1 / (1 + np.exp(-x))


def test_quality_classifier(spark, folder, passed):
    before, kept = after(passed, "quality_classifier")
    model = compression.QualityModel.fit(before, spark.read.parquet(f"{folder}/labels.parquet"))
    want = [repr(tuple(r)) for r in before.collect() if plain_score(model, r.text) >= compression.THRESHOLD]
    assert full(kept) == sorted(want)
    ids = {r.doc_id for r in kept.collect()}
    assert not ids & {k for k in range(120) if k % 4 == 3}  # the bad texts go
    assert len(ids) > 80  # the good ones stay


def test_line_dedup(passed):
    before, kept = after(passed, "line_dedup")
    distinct = dict.fromkeys((r.doc_id, r.text) for r in before.collect())
    long, short, want = [], set(), []
    for i, text in sorted(distinct, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")):
        lines = [] if text is None else text.split("\n")
        out = []
        for line in lines:
            w = words(line)
            if len(w) >= 5:
                copy = any(near(w, s) for s in long)
                long.append(w)
            else:
                copy = bool(w) and tuple(w) in short
                short.add(tuple(w))
            if not copy:
                out.append(line)
        if len(out) == len(lines) or any(words(line) for line in out):
            left = None if text is None else "\n".join(out)
            want.append(repr((i, left, "en", "s", None if left is None else len(left))))
    assert full(kept) == sorted(want)
    assert kept.count() < before.count()


def test_simhash_near_dedup(passed):
    before, kept = after(passed, "simhash_near_dedup")
    rows = before.collect()
    prints = {r.text: fingerprint(r.text, simhash.SHINGLE) for r in rows}
    group = groups(set(prints.values()), simhash.MAX_BITS)
    members = {}
    for r in rows:
        members.setdefault(group[prints[r.text]], []).append(r)
    got = kept.collect()
    assert len(got) == len(members) and set(got) <= set(rows)
    first = {
        g: min((r.doc_id is None, r.doc_id or 0) for r in own) for g, own in members.items()
    }
    assert {group[prints[r.text]]: (r.doc_id is None, r.doc_id or 0) for r in got} == first


def test_benchmark_decontamination(spark, folder, passed):
    before, kept = after(passed, "benchmark_decontamination")

    def tokens(text):
        return re.findall(r"[a-z0-9]+", (text or "").lower())

    items = [tokens(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    want = [
        repr(tuple(r))
        for r in before.collect()
        if not any(len(a) >= 3 and smith_waterman(a, tokens(r.text)) >= 0.5 * len(a) for a in items)
    ]
    assert full(kept) == sorted(want)
    assert kept.count() < before.count()  # passages were there, and went


def test_mixing_to_targets(spark, folder, passed):
    before, mixed = after(passed, "mixing_to_targets")
    labels = mixing.quality_domains(spark.read.parquet(f"{folder}/labels.parquet"))
    model = mixing.DomainModel.fit(before, labels, "domain")
    rows = [(r.doc_id, r.text or "") for r in before.collect()]
    got = mixed.collect()
    assert sorted(repr((r.doc_id, r.tokens)) for r in got) == sorted(repr((i, len(words(t)))) for i, t in rows)

    p, n = model.posteriors([t.encode() for _, t in rows])
    wanted = np.array([mixing.TARGETS.get(d, 0.0) for d in model.domains])
    wanted /= wanted.sum()
    # Projected gradient over all documents at once: full rates, full totals, no replay.
    metric = np.linalg.pinv((p * n[:, None]).T @ p / n.sum() + 1e-9 * np.eye(len(wanted)), hermitian=True)
    rates, error = np.ones(len(rows)), (n @ p) / n.sum() - wanted
    for _ in range(mixing.MAX_STEPS):
        if np.abs(error).max() <= mixing.TOLERANCE:
            break
        rates = np.maximum(rates - p @ (metric @ error), 0.0)
        error = ((rates * n) @ p) / n.sum() - wanted
    want = sorted(zip([repr(i) for i, _ in rows], n, rates), key=lambda r: r[:2])
    ours = sorted(((repr(r.doc_id), r.tokens, r.rate) for r in got), key=lambda r: r[:2])
    assert np.allclose([r[2] for r in ours], [r[2] for r in want], rtol=1e-5, atol=1e-6)
    assert all(abs(sum(r.posteriors) - 1) < 1e-9 and r.copies in (int(r.rate), int(r.rate) + 1) for r in got)
    absent = [t for d, t in mixing.TARGETS.items() if d not in model.domains]
    assert got[0].error == pytest.approx(max([np.abs(error).max(), *absent]), abs=1e-6)


def test_run_gives_the_rows_of_the_last_stage(spark, folder, passed):
    found = corpus_pipeline.run(spark, folder)
    keep = ["doc_id", "tokens", "domain", "copies", F.round("rate", 6)]
    assert full(found.select(*keep)) == full(passed["end"].select(*keep))
