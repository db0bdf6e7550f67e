"""SimHash, line dedup and byte dedup against brute force, on small awkward corpora."""

import hashlib
import random
import re

import pytest
import xxhash

from credsieve.llm import linededup, simhash, suffixes
from credsieve.llm.common import components

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi pi rho".split()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def corpus(seed, n=60):
    rng = random.Random(seed)
    rows = [(None, "no id here but some text at all"), (1000, None), (1001, ""), (1002, " \n\t ")]
    texts = []
    for i in range(n):
        if texts and rng.random() < 0.5:
            parts = rng.choice(texts).split(" ")
            for _ in range(rng.choice([0, 0, 1, 2])):
                parts[rng.randrange(len(parts))] = rng.choice(WORDS)
            text = " ".join(parts)
        else:
            text = " ".join(rng.choice(WORDS) + rng.choice(["", "", "\n"]) for _ in range(rng.randrange(3, 90)))
        texts.append(text)
        rows.append((i, text))
    rows += [rows[5], rows[5], (5, rows[9][1])]  # repeated rows, one id with two texts
    return rows


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 9), (9, 9), (5, 6), (6, 7), (7, 8), (8, 5), (20, 1)]
    chain = [(k, k + 1) for k in range(100, 180)]
    found = components(spark.createDataFrame(edges + chain, "u long, v long")).collect()
    got = {r["node"]: r["component"] for r in found}
    assert got == {1: 1, 2: 1, 3: 1, 20: 1, 9: 9, 10: 9, 5: 5, 6: 5, 7: 5, 8: 5} | dict.fromkeys(
        range(100, 181), 100
    )
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def fingerprint(text, n):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = words(low)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(prints, bits):
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in parent:
        for b in parent:
            if bin(a ^ b).count("1") <= bits:
                parent[find(a)] = find(b)
    return {p: find(p) for p in parent}


@pytest.mark.parametrize("bits,pairwise", [(2, 64), (2, 1), (3, 1)])
def test_simhash_equals_brute_force(documents, monkeypatch, bits, pairwise):
    monkeypatch.setattr(simhash, "PAIRWISE", pairwise)
    rows = corpus(bits)
    docs = documents(rows, "component_id")
    prints = [fingerprint(t, 3) for _, t in rows]
    root = groups(prints, bits)
    lowest = {}
    for (i, _), p in zip(rows, prints):
        if i is not None:
            lowest[root[p]] = min(i, lowest.get(root[p], i))
    want = sorted(repr((i, format(p, "016x"), lowest.get(root[p]))) for (i, _), p in zip(rows, prints))
    got = sorted(repr(tuple(r)) for r in simhash.simhash_groups(docs, 3, bits).collect())
    assert got == want
    kept = simhash.keep_one_of_each_group(docs, 3, bits)
    assert kept.columns == docs.columns
    assert sorted(repr(r.doc_id) for r in kept.collect()) == sorted(
        repr(lowest.get(k)) for k in set(root.values())
    )


def test_simhash_of_an_empty_table(documents):
    assert simhash.simhash_groups(documents([])).count() == 0
    assert simhash.keep_one_of_each_group(documents([])).count() == 0


def near(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def line_corpus():
    base = "one two three four five six"
    return [
        (3, f"{base}\nshort line\n{base} seven\nunrelated words that stand quite alone here"),
        (1, f"one two THREE four five six\nshort line\n\n  {base}\t eight  "),
        (2, f"two three four five six\none two three four five six\nthree four five six seven eight"),
        (2, None),
        (7, ""),
        (7, "one two three four six five"),  # a swap is two edits
        (8, "x " * 3000 + "\n" + "x " * 2999 + "y"),
        (8, "x " * 3000 + "\n" + "x " * 2999 + "y"),
        (None, base),
        (9, "a b c d e\na b c d f\na b c g f\nh b c d e a"),
    ]


def test_lines_equal_brute_force(documents):
    rows = line_corpus()
    docs = documents(rows, "n_removed")
    got = {
        (r.doc_id, r.text): (r.n_lines, r.n_removed, r.n_long_left)
        for r in linededup.dedup_lines(docs).collect()
    }
    seen, want = [], {}
    distinct = dict.fromkeys(rows)
    for i, text in sorted(distinct, key=lambda r: (r[0] is None, r[0] or 0)):
        if text is None:
            want[i, None] = (0, 0, 0)
            continue
        out, long_left = [], 0
        for line in text.split("\n"):
            w = words(line)
            if len(w) < linededup.MIN_WORDS:
                out.append(line)
                continue
            if not any(near(w, s) for s in seen):
                out.append(line)
                long_left += 1
            seen.append(w)
        lines = text.count("\n") + 1
        want[i, "\n".join(out)] = (lines, lines - len(out), long_left)
    assert got == want


def test_copies_of_short_lines_go(documents):
    long = "\u4e00\u4e8c\u4e09" * 200
    rows = [
        (1, f"yes\n\n{long}\n a  b\nc d e f"),
        (2, f"{long}\nno\n \na b \nc d e g\nyes\nyes"),
        (3, f"yes\n{long}\n"),
    ]
    got = {r.doc_id: (r.n_removed, r.text) for r in linededup.dedup_lines(documents(rows), 1).collect()}
    assert got == {1: (0, rows[0][1]), 2: (4, "no\n \nc d e g"), 3: (2, "")}
    kept = {r.doc_id: r.text for r in linededup.without_copied_lines(documents(rows)).collect()}
    assert kept == {1: rows[0][1], 2: "no\n \nc d e g"}


def test_documents_without_copied_lines(documents):
    docs = documents(line_corpus(), "n_lines")
    kept = linededup.without_copied_lines(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert None not in [r.doc_id for r in rows]  # its only line is a copy
    assert all(r.n_chars == len(r.text) for r in rows if r.text is not None)
    assert all(r.n_lines == "x" for r in rows)
    assert linededup.without_copied_lines(documents([])).count() == 0


def removed(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    count = {}
    for t in texts:
        for k in range(len(t) - length + 1):
            count[t[k : k + length]] = count.get(t[k : k + length], 0) + 1
    out = []
    for (i, _), t in zip(rows, texts):
        gone = [False] * len(t)
        for k in range(len(t) - length + 1):
            if count[t[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(map(repr, out))


def test_bytes_equal_brute_force(documents, monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE", 4096)
    rng = random.Random(5)

    def prose(n):
        return " ".join("".join(rng.choices("abcdeé", k=rng.randrange(2, 9))) for _ in range(n))

    shared, other = prose(120), prose(70)
    rows = [
        (1, prose(50) + shared + prose(40)),
        (2, shared),
        (3, prose(3) + shared[:500] + "!" + shared[501:] + other),
        (4, other[3:] + prose(900) + shared[100:] + prose(900)),
        (5, "a" * 1500),  # overlaps itself
        (6, "ab" * 300 + prose(20)),
        (7, prose(100)),
        (7, prose(100)),
        (8, shared[10:420]),
        (9, shared[5:404] + "#"),
        (10, prose(200) * 2),
        (None, None),
        (None, ""),
        (11, "short"),
        (12, prose(2000)),
        (12, None),
    ]
    rows += [rows[6], rows[14]]
    docs = documents(rows, "lows")
    got = suffixes.removed_bytes(docs)
    digests = [
        (r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest())
        for r in got.collect()
    ]
    assert sorted(map(repr, digests)) == removed(rows, suffixes.LENGTH)


def test_bytes_of_an_empty_table(documents):
    assert suffixes.removed_bytes(documents([])).count() == 0
    with pytest.raises(ValueError):
        suffixes.removed_bytes(documents([]), 100).count()


def test_bytes_around_a_hot_passage_stay(documents):
    """Of 160 000 such texts, these pairs agree in the low 32 bits of the outer hash."""
    passage = "".join(random.Random(12).choices("abcdefghij ", k=600))
    numbers = [29704, 41552, 100064, 142686, 85681, 101985]
    rows = [(k, f"{k:09d} this line differs {passage}") for k in numbers]
    got = suffixes.removed_bytes(documents(rows))
    digests = [
        (r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest())
        for r in got.collect()
    ]
    assert sorted(map(repr, digests)) == removed(rows, suffixes.LENGTH)
