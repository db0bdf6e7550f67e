"""Newest versions, repeated rows, repeated weights and what a run leaves behind."""

import os
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from credsieve.operators import partitioning
from credsieve.operators.dictionary import dictionary_match
from credsieve.operators.ledger import latest_per_url
from credsieve.operators.weights import key_weight
from credsieve.plans import scan as S
from credsieve.functions.extract import key_candidates
from credsieve.plans.job import run_collection, run_scan
from credsieve.plans.keyword_search import run_search, search_enterprise
from credsieve.sources.lists import read_confidence

CONFIG = S.ScanConfig(keywords=("token",), unmask=True)


def versions(spark, *rows):
    """(url name, day, content), the file_id by position"""
    url = "https://git.example.com/o/r/blob/main/"
    full = [(k, url + name, f"2024-01-0{day}", text) for k, (name, day, text) in enumerate(rows)]
    files = spark.createDataFrame(full, "file_id long, html_url string, t string, content string")
    return files.select("file_id", "html_url", F.to_timestamp("t").alias("indexed_at"), "content")


SECRET = "a\ntoken = abcd1234\nb\n"


def test_a_removed_keyword_is_gone(spark):
    files = versions(
        spark,
        ("gone.py", 1, SECRET),
        ("gone.py", 2, "a\nnothing\nb\n"),
        ("back.py", 1, "a\nnothing\nb\n"),
        ("back.py", 2, SECRET),
        ("gated.py", 1, SECRET),
        ("gated.py", 2, "token"),  # too short, yet the newest
        ("unread.py", 1, SECRET),
        ("unread.py", 2, None),  # no body was landed, the last known one counts
    )
    want = {"back.py", "unread.py"}

    def names(df, column="URL"):
        return {r[column].rsplit("/", 1)[1] for r in df.collect()}

    assert names(S.scan_creds(files, CONFIG)) == want
    searched = search_enterprise(files, ["token"], CONFIG)
    assert names(searched) == want | {"gated.py"}
    assert names(S.scan_creds(files, replace(CONFIG, dedupe=False))) == want | {"gone.py", "gated.py"}


def test_a_removed_primary_keyword_is_gone(spark):
    files = versions(spark, ("f.py", 1, "acme\n" + SECRET), ("f.py", 2, SECRET))
    config = replace(CONFIG, primary=("acme",), source=S.PUBLIC)
    assert S.scan_creds(files, config).count() == 0
    assert run_scan(files, config)["ledger"].count() == 0


@pytest.mark.parametrize("max_rows", [1000, 1])
def test_equal_rows_stay_apart_in_either_dictionary_path(spark, max_rows):
    rows = spark.createDataFrame([("x", "abc123")] * 2 + [("y", "zzz"), ("z", "abcabc")], "k string, secret string")
    ngrams = spark.createDataFrame([("abc", 1.0), ("abc1", 0.5)], "ngram string, log_total double")
    got = sorted((r.k, r.match) for r in dictionary_match(rows, ngrams, max_rows=max_rows).collect())
    assert got == [("x", 1.5), ("x", 1.5), ("y", 0.0), ("z", 2.0)]


def test_repeated_weights_repeat_no_row(spark, tmp_path):
    rows = spark.createDataFrame([("password", "py")], "kw string, ext string")
    weights = spark.createDataFrame([("password", 4), ("password", 5), ("py", 1)], "key string, value int")
    assert [r.Key_Weight for r in key_weight(rows, weights).collect()] == [6]
    (tmp_path / "w.csv").write_text("key,value\npassword,4\npassword,5\n")
    with pytest.raises(ValueError, match="password"):
        read_confidence(spark, str(tmp_path / "w.csv"))


def scratch_files(spark):
    top = spark.conf.get("spark.checkpoint.dir")
    return {os.path.join(d, f) for d, _, names in os.walk(top) for f in names}


def test_a_run_leaves_no_plain_secret(spark):
    files = versions(spark, ("f.py", 1, SECRET))
    ngrams = spark.createDataFrame([("abc", 1.0)], "ngram string, log_total double")
    before = scratch_files(spark)
    out = run_scan(files, replace(CONFIG, unmask=False), ngrams=ngrams)
    assert out["detections"].count() == 1 and out["ledger"].count() == 1
    left = {p for p in scratch_files(spark) - before}
    assert left and all("abcd1234".encode() not in open(p, "rb").read() for p in left)
    assert not any("/staged-" in p or "/run-" in p for p in left)

    class Broken:
        pass

    before = scratch_files(spark)
    with pytest.raises(Exception):
        run_scan(files, CONFIG, ngrams=Broken())
    assert scratch_files(spark) == before


def test_second_runs_find_new_files_only(spark):
    first = versions(spark, ("a.py", 1, SECRET), ("b.py", 1, "a\nnothing\nb\n"))
    later = first.unionByName(versions(spark, ("c.py", 2, SECRET)))
    search = run_search(first, ["token"], CONFIG)
    assert search["detections"].count() == search["ledger"].count() == 1
    again = run_search(later, ["token"], CONFIG, ledger=search["ledger"])
    assert [r.URL[-4:] for r in again["detections"].collect()] == ["c.py"]
    collected = run_collection(first, CONFIG)
    assert collected["training"].count() == collected["ledger"].count() == 1
    again = run_collection(later, CONFIG, ledger=collected["ledger"])
    assert again["training"].count() == again["ledger"].count() == 1


def test_a_scan_goes_on_from_the_scanned_versions(spark):
    first = versions(spark, ("a.py", 1, SECRET), ("b.py", 1, "a\nnothing\nb\n"), ("c.py", 2, SECRET))
    run = run_scan(first, CONFIG)
    assert run["scanned"].count() == 3
    more = [("b.py", 2, SECRET), ("c.py", 1, SECRET), ("d.py", 1, SECRET), ("a.py", 2, "a\nnothing\nb\n")]
    later = versions(spark, *more).withColumn("file_id", F.col("file_id") + 100)
    both = first.unionByName(later)
    plain = run_scan(both, CONFIG, ledger=run["ledger"])
    pruned = run_scan(both, CONFIG, ledger=run["ledger"], scanned=run["scanned"])
    for out in (plain, pruned):
        assert {r.URL[-4:] for r in out["detections"].collect()} == {"b.py", "d.py"}
        assert out["ledger"].count() == 2
    assert {r.html_url[-4:] for r in pruned["scanned"].collect()} == {"a.py", "b.py", "d.py"}
    # another search has scanned nothing yet
    assert S.unscanned(both, run["scanned"], replace(CONFIG, keywords=("x",))).count() == both.count()
    with pytest.raises(ValueError):
        S.unscanned(both, run["scanned"], replace(CONFIG, dedupe=False))


def test_bodies_are_not_shuffled_to_leave_out_scanned_versions(spark):
    files = versions(spark, ("a.py", 1, SECRET))
    plan = S.unscanned(files, run_scan(files, CONFIG)["scanned"], CONFIG)._jdf.queryExecution()
    text = plan.executedPlan().toString()
    assert "BroadcastHashJoin" in text and "hashpartitioning" not in text


def test_many_new_files_are_spread_by_their_number(spark, monkeypatch):
    first = versions(spark, ("a.py", 1, SECRET), ("b.py", 1, SECRET))
    scanned = run_scan(first, CONFIG)["scanned"]
    later = versions(spark, *[(f"n{k}.py", 2, SECRET) for k in range(40)], ("a.py", 2, SECRET))
    later = later.withColumn("file_id", F.col("file_id") + 100)
    nameless = later.limit(1).withColumn("file_id", F.lit(None).cast("long"))
    both = first.unionByName(later).unionByName(later.where("file_id < 103")).unionByName(nameless)
    few = S.unscanned(both, scanned, CONFIG)
    monkeypatch.setattr(partitioning, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(S, "NEW_FILES_A_TASK", 1, raising=False)
    many = S.unscanned(both, scanned, CONFIG)
    assert many.columns == few.columns == both.columns
    assert sorted(many.collect()) == sorted(few.collect()) and many.count() == 44
    assert many.rdd.getNumPartitions() == 45  # one id a task
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "BroadcastHashJoin" not in plan


def test_urls_are_ranked_by_a_hash_first(spark):
    files = versions(spark, ("a.py", 1, SECRET), ("a.py", 2, SECRET)).drop("content")
    files = files.unionByName(files.withColumn("html_url", F.lit(None).cast("string")))
    newest = latest_per_url(files)
    assert [r.file_id for r in newest.collect()] == [1, 1]
    assert "xxhash64" in newest._jdf.queryExecution().executedPlan().toString()


def test_commits_of_other_files_are_left_out_first(spark):
    from credsieve import schemas
    from credsieve.operators.commits import attach_commits

    keys = ["owner", "repo", "file_path"]
    df = spark.createDataFrame([("o", "r", "p"), ("o", "r", "q")], keys)
    replies = [("o", "r", "p", 404, "[]"), ("o", "r", "p", 200, "[]"), ("x", "r", "p", 200, "[]")]
    commits = spark.createDataFrame(replies, schemas.COMMITS_RAW)
    wanted = df.unionByName(df)
    got = attach_commits(df, commits, wanted)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, attach_commits(df, commits).collect()))
    assert "LeftSemi" in got._jdf.queryExecution().executedPlan().toString()


def test_patterns_are_obeyed(spark):
    from credsieve import resources as R

    line = f"awsSecretKey {'a' * 39}B x"
    rows = spark.createDataFrame([(line,)], "t string")

    def found(patterns):
        return rows.select(key_candidates(F.col("t"), patterns).alias("k")).first().k

    assert found(()) == []
    assert found((R.AWS_SECRET_LINE,)) == [line[:-2]]
    assert line[:-2] in found(R.KEY_BANK) and line[:-2] not in found(R.KEY_PATTERNS)
