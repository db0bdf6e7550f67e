"""Hard negatives and vector codes against plain loops and SQL."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from credsieve.llm import negatives, vectorcodes
from credsieve.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, anchor_id string, rank string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def usable(vector):
    return vector is not None and all(x is not None and math.isfinite(x) for x in vector)


def integers(vector, scale):
    return [math.floor(scale * float(np.float32(x))) for x in vector]


# ---- hard negatives ---------------------------------------------------------------------


@pytest.mark.parametrize("largest", [1, 40, 3000, 1 << 20, 1 << 27])
def test_packed_products_are_exact(largest):
    rng = np.random.RandomState(5)
    for n, m, width in ((7, 5, 64), (1, 1, 3), (0, 2, 4), (2, 0, 4), (3, 2, 0), (50, 20, 9)):
        a = rng.randint(-largest, largest + 1, (m, width))
        b = rng.randint(-largest, largest + 1, (n, width))
        assert (negatives.inner_products(a, b) == a @ b.T).all()
        assert (negatives.inner_products(abs(a), abs(b)) == abs(a) @ abs(b).T).all()


def test_the_best_of_many_runs():
    rng = np.random.RandomState(6)
    best, every = negatives.Best(3, 4), [set(), set(), set()]
    for _ in range(30):
        scores, ids = rng.randint(0, 9, (2, 25)), rng.randint(0, 40, 25)
        groups = np.array([0, 2])
        allowed = rng.rand(2, 25) < 0.7
        for g, row, ok in zip(groups, scores, allowed):
            every[g] |= {(-s, i) for s, i, a in zip(row, ids, ok) if a}
        best.add(groups, scores, allowed.copy(), ids)
    got = best.frame()
    for g in range(3):
        own = got[got["group"] == g]
        assert [(-s, i) for s, i in zip(own["score"], own["id"])] == sorted(every[g])[:4]


def brute_negatives(rows, anchor, positives=5, count=10, low=30, high=90):
    """Rows of the result; equal (id, label, vector) rows count once."""
    own = {(i, lab, tuple(integers(v, 256))) for i, v, lab in rows if usable(v) and None not in (i, lab)}
    out = set()
    for a in own:
        if not anchor(a[0]):
            continue
        scored = {
            (-sum(x * y for x, y in zip(a[2], b[2])), b[0], a[1] == b[1]) for b in own if b[0] != a[0]
        }
        for minus, positive, same in [s for s in sorted(scored) if s[2]][:positives]:
            fits = [s for s in sorted(scored) if not s[2] and 30 * -minus <= 100 * -s[0] <= 90 * -minus]
            for rank, s in enumerate(fits[:count], 1):
                out.add((a[0], positive, rank, s[1], -minus, -s[0]))
    return out


def random_rows(rng, n, width=6, ids=200):
    rows = []
    for _ in range(n):
        vector = [rng.choice([-1.0, -0.5, 0.1, 0.3, 0.7, 1.0]) for _ in range(width)]
        rows.append((rng.randrange(ids), vector, rng.randrange(3)))
    return rows


def test_hard_negatives_equal_brute_force(spark, monkeypatch):
    rng = random.Random(7)
    rows = random_rows(rng, 300)
    rows += [rows[0], rows[0], rows[5]]
    rows += [(None, [1.0] * 6, 1), (3, None, 1), (4, [1.0] * 6, None), (10, [0.5, None] * 3, 0)]
    rows += [(20, [float("nan")] * 6, 0), (30, [float("inf")] * 6, 0), (40, [], 1), (50, [0.7] * 3, 2)]
    want = brute_negatives(rows, lambda i: i % 10 == 0)
    assert want
    df = table(spark, rows).repartition(5)
    is_anchor = F.col("vec_id") % 10 == 0
    found = negatives.hard_negatives(df, is_anchor).collect()
    assert {tuple(r) for r in found} == want
    # Many blocks of anchors and few scores at a time give the same rows.
    monkeypatch.setattr(negatives, "CELLS", 40)
    small = negatives.hard_negatives(df, is_anchor, block=7).collect()
    assert {tuple(r) for r in small} == want
    assert negatives.hard_negatives(df, F.lit(False)).count() == 0
    assert negatives.hard_negatives(df.limit(0), is_anchor).count() == 0


def test_one_vector_in_a_third_of_the_rows(spark):
    rng = random.Random(8)
    hot = [(k, [0.7] * 6, 1) for k in range(0, 600, 2)]
    rows = hot + [(k, v, lab) for k, (_, v, lab) in zip(range(1, 1200, 2), random_rows(rng, 600))]
    found = negatives.hard_negatives(table(spark, rows), F.col("vec_id") % 100 == 0)
    assert {tuple(r) for r in found.collect()} == brute_negatives(rows, lambda i: i % 100 == 0)


def test_registered_negatives_equal_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    want = {tuple(r) for r in con.execute(negatives.ORACLE).fetchall()}
    assert {tuple(r) for r in QUERIES["op11_hard_negatives"](spark, SF).collect()} == want


# ---- vector codes -----------------------------------------------------------------------


def brute_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    """(vec_id, code, error, label_error, sha) of each kept row by plain k-means."""
    kept = [(i, integers(v, scale), lab) for i, v, lab in rows if usable(v)]
    size = -(-max(len(v) for _, v, _ in kept) // parts)
    kept = [(i, v + [0] * (parts * size - len(v)), lab) for i, v, lab in kept]
    first = {}
    for i, v, _ in kept:
        if i is not None:
            first[i] = min(first.get(i, v), v)
    books = np.array([first[i] for i in sorted(first)[:entries]]).reshape(-1, parts, size)
    books = books.transpose(1, 0, 2).copy()
    x = np.array([v for _, v, _ in kept]).reshape(-1, parts, size)

    def assign():
        distances = ((x[:, :, None, :] - books[None]) ** 2).sum(axis=3)
        return distances.argmin(axis=2), distances.min(axis=2).sum(axis=1)

    for _ in range(rounds):
        own, _ = assign()
        for p in range(parts):
            for e in range(books.shape[1]):
                if (own[:, p] == e).any():
                    books[p, e] = x[own[:, p] == e, p].sum(axis=0) // (own[:, p] == e).sum()
    own, errors = assign()
    by_label = {}
    for (_, _, lab), error in zip(kept, errors.tolist()):
        by_label[lab] = by_label.get(lab, 0) + error
    sha = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return [
        (i, "".join(f"{c:02x}" for c in codes), error, by_label[lab], sha)
        for (i, _, lab), codes, error in zip(kept, own.tolist(), errors.tolist())
    ]


def codes(df, **options):
    return sorted(map(repr, (tuple(r) for r in vectorcodes.compress(df, **options).collect())))


def test_bounds_assign_like_all_distances():
    rng = np.random.RandomState(9)
    for grid in (3, 5000):
        x = rng.randint(-grid, grid + 1, (500, 3))
        entries = rng.randint(-grid, grid + 1, (9, 3))
        bounds = vectorcodes.Bounds.exact(vectorcodes.squared(x, entries), 4)
        saved = 0
        for b in (4, 3, 3, 1, 1, 1):
            moved = entries + rng.randint(-1 - grid // 100, 2 + grid // 100, entries.shape)
            step = np.sqrt(((moved - entries) ** 2).sum(axis=1).astype(float))
            entries = moved
            bounds.drift(step * (1 + vectorcodes.MARGIN))
            used = bounds.reassign(x, entries, b)
            distances = vectorcodes.squared(x, entries)
            assert (bounds.own == distances.argmin(axis=1)).all()
            # All bounds hold, in order.
            root = np.sqrt(distances)
            at = np.arange(len(x))[:, None]
            assert (bounds.upper >= root[at[:, 0], bounds.own] - 1e-6).all()
            assert (bounds.lower <= root[at, bounds.near] + 1e-6).all()
            rest = root.copy()
            rest[at, np.column_stack((bounds.own, bounds.near))] = np.inf
            assert (bounds.outer <= rest.min(axis=1) + 1e-6).all()
            assert bounds.near.shape[1] == b
            saved += (used < 9).sum()
        assert saved > 500


def test_next_b_follows_need():
    used = np.zeros(17, int)
    used[[0, 1, 2]] = 500, 400, 100
    assert vectorcodes.next_b(used, 4, 16) == 2
    used[3] = 100
    assert vectorcodes.next_b(used, 4, 16) == 3
    used[:] = 0
    used[0] = 5
    assert vectorcodes.next_b(used, 4, 16) == 2 and vectorcodes.next_b(used, 1, 16) == 1


def test_codes_equal_plain_k_means(spark):
    rng = random.Random(10)
    rows = random_rows(rng, 400, width=16, ids=5000)
    rows += [rows[0], rows[0], (rows[3][0], rows[4][1], None), (rows[5][0], rows[6][1], None)]
    rows += [(None, rows[0][1], 1), (1, None, 1), (2, [None] * 16, 1), (3, [float("nan")] * 16, 1)]
    rows += [(4, [float("-inf")] * 16, 1), (7000, [], 2), (7001, [0.3] * 5, 2)]
    df = table(spark, rows).repartition(4)
    assert codes(df) == sorted(map(repr, brute_codes(rows)))
    options = {"parts": 3, "entries": 4, "rounds": 2, "scale": 10}
    assert codes(df, **options) == sorted(map(repr, brute_codes(rows, **options)))
    few = [(k, [float(k), 1.0], k % 2) for k in range(3)]
    assert codes(table(spark, few)) == sorted(map(repr, brute_codes(few)))
    assert codes(df.limit(0)) == []


def test_bounds_are_kept_and_b_adapts(spark):
    trained = vectorcodes.train(spark.read.parquet(f"{SF}/embeddings.parquet"))
    assert trained.b[0] == [4] * 8 and all(2 <= n <= 4 for n in trained.b[-1])
    assert sum(trained.b[-1]) < 32
    last = trained.used[-1].sum(axis=0)
    # Most cases of the last rounds need no look at all entries.
    assert last[-1] < 0.5 * 8 * 500


def test_registered_codes_equal_plain_k_means(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label")
    want = brute_codes([tuple(r) for r in rows.collect()])
    got = QUERIES["op13_vector_codes"](spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted(want)
