"""URL filters, quality rules, compression classifier and decontamination."""

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

from credsieve.llm import common, compression, decontaminate, quality_rules, urlfilter
from credsieve.llm.common import Words

SF = "/root/testdata/sf0.01"


def prose(rng, n, letters="abcdefghijklm"):
    return " ".join("".join(rng.choices(letters, k=rng.randrange(2, 8))) for _ in range(n))


URLS = [
    (1, "https://example.org/es/a?x"),
    (2, "http://BLOG.Example.ORG/en/148#y"),
    (3, "https://myexample.org/en/1"),
    (4, "https://org"),
    (5, "https://a.com/fr/1://b"),
    (6, "x://a.b.com/de/"),
    (6, "x://a.b.com/de/"),
    (7, None),
    (8, "no scheme"),
    (None, "http://com/de/q"),
    (9, ""),
    (10, "http://..org/"),
    (11, "http://a.com/" + "p" * 5000),
]


def test_urls_equal_sql(spark):
    pages = spark.createDataFrame(
        [(i, u, "h", "x") for i, u in URLS], "page_id long, url string, html string, verdict string"
    )
    found = urlfilter.judge_urls(pages, urlfilter.rule_table(spark, urlfilter.RULES))
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(URLS, columns=["page_id", "url"], dtype=object))
    want = con.execute(urlfilter.ORACLE).fetchall()
    assert sorted(map(repr, found.collect())) == sorted(
        f"Row(page_id={None if i is None else int(i)}, host={h!r}, path={p!r}, rule={r!r}, verdict={v!r})"
        for i, h, p, r, v in want
    )
    assert urlfilter.judge_urls(pages.limit(0), urlfilter.rule_table(spark, urlfilter.RULES)).count() == 0


def test_nested_rules_equal_brute_force(spark):
    rng = random.Random(3)
    hosts = ["a.b.c", "b.c", "c", "x.b.c", "b", "", "c.c"]
    paths = ["", "/", "/p", "/p/", "/p/q", "/pp", "/\uffff", "/p\u0001"]
    rules = [(h, p, rng.choice(["allow", "block"])) for h in hosts if h for p in paths if rng.random() < 0.6]
    rules += [rules[0][:2] + ("block",), rules[0][:2] + ("allow",)]  # block wins
    urls = [(k, f"http://{h}{p}{t}") for k, (h, p, t) in enumerate(
        (h, p, t) for h in hosts for p in paths for t in ("", "z", "/q", "?x"))]
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    pages = spark.createDataFrame(urls, "page_id long, url string")
    blocked = {(h, p) for h, p, v in rules if v == "block"}
    for row in urlfilter.judge_urls(pages, table).collect():
        fits = {
            (h, p)
            for h, p, _ in rules
            if (row.host == h or row.host.endswith("." + h)) and row.path.startswith(p)
        }
        best = max(fits, key=lambda x: (len(x[0] + x[1]), len(x[0])), default=None)
        assert row.rule == (best and best[0] + best[1])
        assert row.verdict == ("block" if best in blocked else "allow")
    nothing = urlfilter.judge_urls(pages, table.limit(0))
    assert {r.verdict for r in nothing.collect()} == {"allow"}


def base_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    many = Counter(windows)
    covered = {k for i, x in enumerate(windows) if many[x] > 1 for k in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(w)
    failed = n < 10 or 100 * len(covered) > 20 * n
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return n, sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered), failed


def test_quality_rules(spark, documents):
    rng = random.Random(1)
    rows = [(k, prose(rng, rng.randrange(1, 60))) for k in range(80)]
    rows += [(100 + k, prose(rng, 40, "&%$qwxyz")) for k in range(20)]
    rows += [(None, None), (200, ""), (201, "é\u00a0ü # x\n\n x \n x "), (202, "a b c d e f " * 30), rows[0]]
    rows += [(203, "a\nb\na\nb\n" * 5), (204, " ".join(prose(rng, 30).split() * 2))]
    docs = documents(rows, "good")
    trusted = spark.createDataFrame([(k,) for k in range(0, 80)] + [(5,), (None,)], "doc_id long")
    got = quality_rules.judge_texts(docs, trusted).collect()
    by_row = sorted(repr((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines,
                          r.n_repeat_words, r.base_failed)) for r in got)
    want = []
    for i, t in rows:
        *counts, failed = base_counts(t)
        want.append(repr((i, *counts, failed)))
    assert by_row == sorted(want)
    for r in got:
        assert r.kept == (not r.base_failed and r.llr >= quality_rules.THRESHOLD)
        if r.doc_id is not None and 100 <= r.doc_id < 120:
            assert not r.kept
        elif r.doc_id is not None and r.doc_id < 80:
            assert r.kept == (not r.base_failed)
    alone = quality_rules.judge_texts(docs, trusted.limit(0)).collect()
    assert all(r.llr == 0 and r.kept == (not r.base_failed) for r in alone)
    assert quality_rules.judge_texts(documents([]), trusted).count() == 0


def bucket_counts(texts):
    """Counts of the hashed words and word pairs, one text at a time."""
    total = np.zeros(quality_rules.BUCKETS, np.int64)
    for text in texts:
        buckets, _ = quality_rules.gram_buckets(Words([(text or "").encode()]))
        np.add.at(total, buckets, 1)
    return total


@pytest.mark.parametrize("bits", [1 << 25, 32768])
def test_ratios_and_verdicts_equal_brute_force(spark, documents, monkeypatch, bits):
    monkeypatch.setattr(common, "FILTER_BITS", bits)
    rng = random.Random(3)
    rows = [(k, prose(rng, rng.randrange(1, 40))) for k in range(120)] + [(None, "a b c"), (3, "twice"), (4, None)]
    trusted = {k for k in range(0, 120, 3)} | {5000}
    table = spark.createDataFrame([(k,) for k in trusted] + [(6,), (6,), (None,)], "doc_id long")
    trusted |= {6}
    docs = documents(rows, "_bucket")
    counts = quality_rules.gram_counts(docs, table).toPandas().sort_values("bucket")
    raw, target = bucket_counts([t for _, t in rows]), bucket_counts([t for i, t in rows if i in trusted])
    assert (counts["bucket"].to_numpy() == np.flatnonzero(raw)).all()
    assert (counts["raw"].to_numpy() == raw[raw > 0]).all()
    assert (counts["target"].to_numpy() == target[raw > 0]).all()
    smooth = [n + quality_rules.SMOOTHING * n.sum() / quality_rules.BUCKETS for n in (target, raw)]
    ratio = np.log(smooth[0] / smooth[0].sum()) - np.log(smooth[1] / smooth[1].sum())
    want = []
    for i, text in rows:
        buckets, _ = quality_rules.gram_buckets(Words([(text or "").encode()]))
        llr = ratio[buckets].sum() / (len(buckets) + quality_rules.PRIOR_GRAMS)
        want.append((repr(i), round(llr, 9), not base_counts(text)[-1] and llr >= quality_rules.THRESHOLD))
    got = quality_rules.judge_texts(docs, table).collect()
    assert sorted((repr(r.doc_id), round(r.llr, 9), r.kept) for r in got) == sorted(want)


def test_only_trusted_texts_are_moved(spark, documents):
    docs = documents([(k, f"text number {k}") for k in range(2000)])
    trusted = spark.createDataFrame([(k,) for k in range(0, 2000, 50)], "doc_id long")
    rows = quality_rules.trusted_rows(docs, trusted)
    assert rows.count() == 40
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("strategy=merge") < plan.index("bitmap")  # the filter lies below the join


def test_quality_score(spark, documents):
    rng = random.Random(2)
    rows, labels = [], []
    for k in range(400):
        good = k % 3 > 0
        rows.append((k, prose(rng, 80, "abcdefghijklm" if good else "&%$qwxyz!|")))
        labels.append((k, int(good), 0))
    rows += [(None, None), (900, ""), (901, "\n"), rows[0]]
    labels += [(0, 0, 0), (None, 1, 1), (3, None, 0), (5000, 1, 0)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = documents(rows, "score")
    got = compression.score_quality(docs, table).collect()
    assert len(got) == len(rows)
    right = 0
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        right += r.doc_id is not None and r.doc_id < 400 and r.predicted == int(r.doc_id % 3 > 0)
    assert right >= 0.98 * 400
    kept = compression.keep_good(docs, table)
    assert kept.columns == docs.columns and 250 < kept.count() < 290
    assert compression.score_quality(documents([]), table).count() == 0
    unlabelled = compression.score_quality(docs, table.limit(0)).collect()
    assert {r.score for r in unlabelled} == {0.5}


@pytest.mark.parametrize("sf", [SF])
def test_quality_score_on_held_out_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = compression.score_quality(docs, labels).where("held_out").join(labels, "doc_id").collect()
    good = [r.score for r in rows if r.quality == 1]
    bad = [r.score for r in rows if r.quality == 0]
    wins = sum((g > b) + (g == b) / 2 for g in good for b in bad)
    assert wins / (len(good) * len(bad)) > 0.9


def smith_waterman(a, b):
    best = 0
    row = [0] * (len(b) + 1)
    for x in a:
        before, row = row, [0] * (len(b) + 1)
        for j, y in enumerate(b, 1):
            row[j] = max(0, before[j - 1] + (1 if x == y else -1), before[j] - 1, row[j - 1] - 1)
            best = max(best, row[j])
    return best


def test_contaminated_pairs(spark, documents):
    rng = random.Random(4)
    items = [(k, prose(rng, rng.randrange(15, 50))) for k in range(12)]
    items += [(50, None), (51, "too short"), (52, ""), items[0], (53, items[1][1])]
    rows = []
    for k in range(60):
        passage = items[k % 12][1].split()
        edits = k // 12  # 0 to 4 words replaced, dropped or added
        for _ in range(edits):
            at = rng.randrange(len(passage))
            how = rng.choice("rda")
            passage[at : at + (how != "a")] = [] if how == "d" else [prose(rng, 1, "xyz")]
        text = prose(rng, 40) + " " + ", ".join(passage).upper() + ".\n" + prose(rng, 200)
        rows.append((k, text))
    rows += [(100 + k, prose(rng, 300)) for k in range(40)]
    rows += [(None, items[2][1]), (200, None), (201, ""), rows[3], (202, (items[3][1] + " ") * 3)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(rows, "item_id")
    found = decontaminate.contaminated_pairs(docs, bench)
    got = Counter((r.doc_id, r.item_id) for r in found.collect())
    want = Counter()

    def tokens(text):
        return re.findall(r"[a-z0-9]+", (text or "").lower())

    for i, text in rows:
        for item, passage in set(items):
            a = tokens(passage)
            if len(a) >= 3 and smith_waterman(a, tokens(text)) >= 0.5 * len(a):
                want[i, item] += 1
    assert got == want and len(want) > 60
    kept = decontaminate.keep_clean(docs, bench)
    assert kept.columns == docs.columns
    hit = {i for i, _ in want}
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(
        repr(i) for i, _ in rows if i not in hit
    )
    assert decontaminate.contaminated_pairs(documents([]), bench).count() == 0
    assert decontaminate.contaminated_pairs(docs, bench.limit(0)).count() == 0


def edited(rng, passage, how):
    """A copy that scores half of its item or a little more."""
    out = []
    for k, word in enumerate(passage):
        if how == "inserted":  # a word after every second one
            out += [word, prose(rng, 1, "xyz")] if k % 2 and k < len(passage) - 1 else [word]
        elif how == "dropped":  # every fourth word
            out += [word] if k % 4 != 2 else []
        elif how == "replaced":
            out += [word] if k % 4 != 2 else [prose(rng, 1, "xyz")]
        else:
            out += [[word], [word, prose(rng, 1, "xyz")], [], [word], [word]][k % 5]
    return out


@pytest.mark.parametrize("copies", [1, 40])
def test_copies_full_of_edits_are_found(spark, documents, copies):
    rng = random.Random(12)
    common = prose(rng, 40).split()
    items, rows, want = [], [], set()
    for k, how in enumerate(("inserted", "dropped", "replaced", "mixed")):
        # Half of the item's words are everyday words of all documents.
        passage = [rng.choice(common) if j % 2 else prose(rng, 1) for j in range(31)]
        items.append((k, " ".join(passage)))
        for c in range(copies):
            doc = 1000 * k + c
            shown = edited(rng, passage, how)
            assert smith_waterman(passage, shown) >= 0.5 * len(passage)
            rows.append((doc, " ".join([*rng.choices(common, k=60), *shown, *rng.choices(common, k=60)])))
            want.add((doc, k))
    rows += [(9000 + k, " ".join(rng.choices(common, k=150))) for k in range(120)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated_pairs(documents(rows), bench).collect()}
    tokens = {i: t.split() for i, t in rows}
    brute = {
        (i, item) for i, words in tokens.items() for item, text in items
        if smith_waterman(text.split(), words) >= 0.5 * 31
    }
    assert found == brute and want <= found


@pytest.mark.parametrize("meetings", [1 << 21, 50])
def test_random_alignments_equal_brute_force(spark, documents, monkeypatch, meetings):
    """Texts over few words, where seeds are in every document and items overlap."""
    monkeypatch.setattr(decontaminate, "MEETINGS", meetings)
    rng = random.Random(13)
    items = [(k, " ".join(rng.choices("abcde", k=rng.randrange(1, 16)))) for k in range(25)]
    rows = [(k, " ".join(rng.choices("abcdefg", k=rng.randrange(0, 40)))) for k in range(50)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contaminated_pairs(documents(rows), bench)
    got = {(r.doc_id, r.item_id): round(r.score * len(dict(items)[r.item_id].split())) for r in found.collect()}
    want = {}
    for i, text in rows:
        for item, passage in items:
            score = smith_waterman(passage.split(), text.split())
            if len(passage.split()) >= 3 and score >= 0.5 * len(passage.split()):
                want[i, item] = score
    assert set(got) == set(want) and len(want) > 60
    assert all(got[k] <= want[k] for k in got)


def test_rare_seeds_leave_no_copy_without_one():
    """Of every set of seeds that a copy may keep, enough are looked for."""
    rng = random.Random(14)
    for n in range(3, 40):
        items = decontaminate.Items([0], [" ".join(f"w{k}" for k in range(n))])
        frequency = np.array([rng.randrange(100) for _ in items.keys])
        items.choose_rare(frequency)
        left = len(items.at)
        seeds = n - 1
        # The worst copy keeps kept_seeds of them, the ones that are not looked for first.
        assert decontaminate.kept_seeds(n) - (seeds - left) == items.required[0] >= 1
        chosen = {int(frequency[np.searchsorted(items.first, k, "right") - 1]) for k in range(left)}
        assert max(chosen) <= sorted(frequency)[left - 1]


def test_seeds_of_an_item_in_every_document_stay(spark, documents):
    rng = random.Random(6)
    passage = prose(rng, 30)
    rows = [(k, prose(rng, 20) + " " + passage + " " + prose(rng, 20)) for k in range(50)]
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    assert decontaminate.contaminated_pairs(documents(rows), bench).count() == 50


@pytest.mark.parametrize("total,copies", [(100, 1), (300, 100)])
@pytest.mark.parametrize("leak", ["edited", "partial"])
def test_edited_or_partial_copies_alone_are_found(spark, documents, total, copies, leak):
    rng = random.Random(8)
    passage = prose(rng, 30).split(" ")
    if leak == "edited":  # every twelfth word replaced; no document holds the item whole
        shown = [w if k % 12 != 5 else "replaced" for k, w in enumerate(passage)]
    else:
        shown = passage[:18]
    rows = [(k, " ".join([prose(rng, 20), *(shown if k < copies else []), prose(rng, 20)])) for k in range(total)]
    bench = spark.createDataFrame([(1, " ".join(passage))], "item_id long, text string")
    found = decontaminate.contaminated_pairs(documents(rows), bench).collect()
    assert sorted(r.doc_id for r in found) == list(range(copies))
    assert decontaminate.keep_clean(documents(rows), bench).count() == total - copies
