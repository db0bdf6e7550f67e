"""Results that count as a whole, and ledgers that grow."""

import os

import pytest
from pyspark.sql import functions as F

from credsieve.operators.dictionary import dictionary_match
from credsieve.plans import job
from credsieve.plans import scan as S
from credsieve.scratch import new_path, written
from credsieve.sinks.runs import RunStore
from credsieve.sinks.seen import SeenLedger
from credsieve.streaming import stream

CONFIG = S.ScanConfig(keywords=("token",), keep_secret=True, unmask=True)
SECRET = "a\ntoken = abcd1234wxyz\nb\n"


def files(spark, *rows):
    data = [(k, f"https://git.example.com/o/r/blob/main/{n}", t, c) for k, (n, t, c) in enumerate(rows)]
    df = spark.createDataFrame(data, "file_id long, html_url string, t int, content string")
    return df.select("file_id", "html_url", F.timestamp_seconds("t").alias("indexed_at"), "content")


def fingerprints(spark, ids):
    rows = spark.createDataFrame([(i,) for i in ids], "i long")
    return rows.select(F.md5(F.col("i").cast("string")).alias("hashed_url"), F.lit("u").alias("url"))


# ---- stores of runs -------------------------------------------------------------------------


def test_a_run_counts_as_a_whole(spark):
    store = RunStore(spark, new_path(spark, "store"))
    assert store.runs() == [] and store.read("a") is None
    a, b = spark.range(3).toDF("x"), spark.createDataFrame([("y",)], "s string")
    assert store.commit("r1", {"a": a, "b": b})

    class Broken:
        schema = b.schema

        @property
        def write(self):
            raise RuntimeError("the ledger could not be written")

    with pytest.raises(RuntimeError):
        store.commit("r2", {"a": a, "b": Broken()})
    assert store.runs() == ["r1"] and store.read("a").count() == 3
    # Done over it counts, and done twice it counts once.
    assert store.commit("r2", {"a": a, "b": b}) and not store.commit("r2", {"a": a, "b": b})
    assert store.read("a").count() == 6 and store.read("b").count() == 2
    # Another process sees the same.
    assert RunStore(spark, store.path).runs() == ["r1", "r2"]


def test_what_a_killed_writer_leaves_is_never_read(spark):
    store = RunStore(spark, new_path(spark, "store"))
    store.commit("r1", {"a": spark.range(2).toDF("x")})
    left = f"{store.path}/data/r2-dead/a"
    spark.range(9).toDF("x").write.parquet(left)
    assert store.read("a").count() == 2
    assert store.commit("r2", {"a": spark.range(1).toDF("x")}) and store.read("a").count() == 3
    store.tidy()
    assert not os.path.exists(left) and store.read("a").count() == 3


def test_two_writers_cannot_both_pass_the_check(spark, monkeypatch):
    path = new_path(spark, "store")
    first, second = RunStore(spark, path), RunStore(spark, path)
    enter, published = first._publish, []

    def slow(number, runs):
        # The other writer commits between the check and the manifest.
        if not published:
            published.append(second.commit("other", {"a": spark.range(1).toDF("y")}))
        return enter(number, runs)

    monkeypatch.setattr(first, "_publish", slow)
    with pytest.raises(ValueError, match="columns"):
        first.commit("mine", {"a": spark.range(5).toDF("x")})
    assert first.runs() == ["other"] and first.read("a").columns == ["y"]
    # With the same columns both count, and neither loses the other.
    published.clear()
    monkeypatch.setattr(second, "commit", lambda run, t: RunStore(spark, path).commit("third", t))
    assert first.commit("mine", {"a": spark.range(5).toDF("y")})
    assert first.runs() == ["other", "third", "mine"] and first.read("a").count() == 7


def test_merged_runs_are_read_once(spark):
    store = RunStore(spark, new_path(spark, "store"))
    for k in range(4):
        store.commit(f"r{k}", {"a": spark.range(k, k + 1).toDF("x"), "b": spark.range(1).toDF("z")})
    store.merge("a")
    assert sorted(r.x for r in store.read("a").collect()) == [0, 1, 2, 3]
    assert store.read("b").count() == 4 and store.runs() == ["r0", "r1", "r2", "r3"]
    assert not store.commit("r1", {"a": spark.range(9).toDF("x")})
    store.tidy()
    assert store.read("a").count() == 4 and store.read("b").count() == 4


def test_runs_go_on_from_the_store(spark):
    store = RunStore(spark, new_path(spark, "store"))
    one = files(spark, ("a.py", 1, SECRET), ("b.py", 1, "a\nnothing\nb\n"))
    assert job.committed_run(store, "1", one, CONFIG)
    assert not job.committed_run(store, "1", one, CONFIG)
    both = one.unionByName(files(spark, ("c.py", 2, SECRET)).withColumn("file_id", F.lit(7).cast("long")))
    assert job.committed_run(store, "2", both, CONFIG)
    assert sorted(r.URL[-4:] for r in store.read("detections").collect()) == ["a.py", "c.py"]
    assert store.read("ledger").count() == 2 and store.read("report").count() > 0


# ---- bucketed ledgers ------------------------------------------------------------------------


def test_a_ledger_is_not_shuffled(spark):
    seen = SeenLedger(spark, new_path(spark, "seen"), buckets=8)
    seen.append(fingerprints(spark, range(0, 3000, 2)), "run1")
    rows = written(fingerprints(spark, range(3000)), "rows")
    new = seen.drop_seen(rows)
    assert new.count() == 1500
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = seen.drop_seen(rows)._jdf.queryExecution().executedPlan().toString()
        few = seen.drop_seen(rows.limit(2))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    left, right = plan.split("LeftAnti", 1)[1].split("FileScan", 1)
    assert "Exchange hashpartitioning" in left and "Bucketed: true" in right and "Exchange" not in right
    # Two fingerprints lie in two buckets at most, and no others are read.
    assert "SelectedBucketsCount: 2 out of 8" in few or "SelectedBucketsCount: 1 out of 8" in few


def test_parts_of_a_ledger(spark):
    path = new_path(spark, "seen")
    seen = SeenLedger(spark, path, buckets=4)
    rows = written(fingerprints(spark, range(60)), "rows")
    assert seen.drop_seen(rows).count() == 60
    for run, ids in (("1", range(10)), ("2", range(5, 20)), ("3", range(20, 30))):
        seen.append(fingerprints(spark, ids), run)
    seen.append(fingerprints(spark, range(20, 25)), "3")  # done over with fewer rows
    assert seen.drop_seen(rows).count() == 35 and seen.drop_seen(rows, before="3").count() == 40
    assert seen.drop_seen(rows, few=0).count() == 35
    seen.merge("2")
    assert len(seen.runs()) == 2 and seen.read().count() == 25
    assert seen.drop_seen(rows, before="3").count() == 40
    # Another session finds the buckets and the parts; another number of buckets is not its choice.
    other = SeenLedger(spark.newSession(), path, buckets=16)
    assert other.buckets == 4
    other.append(fingerprints(spark, range(25, 40)), "4")
    assert seen.drop_seen(rows).count() == 20
    seen.merge("4")
    assert len(seen.runs()) == 1 and seen.drop_seen(rows).count() == 20
    with pytest.raises(ValueError):
        seen.append(rows, "x'y")


def test_twenty_batches_keep_few_parts(spark):
    path, out, state = (new_path(spark, n) for n in ("seen", "out", "state"))
    source = new_path(spark, "source")
    at = F.lit("2024-01-01").cast("timestamp")
    for k in range(20):
        # Every batch repeats one fingerprint of each earlier batch, days later.
        rows = fingerprints(spark, [*range(k), 100 + k]).withColumn("indexed_at", at + F.expr(f"INTERVAL {2 * k} DAYS"))
        rows = rows.unionByName(fingerprints(spark, [k]).withColumn("indexed_at", at + F.expr(f"INTERVAL {2 * k} DAYS")))
        rows.coalesce(1).write.mode("append").parquet(f"{source}/b={k:02d}")
    schema = "hashed_url string, url string, indexed_at timestamp"
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{source}/b=*")
    stream.unseen_stream(read, out, path, state, "1 day").awaitTermination()
    found = spark.read.parquet(out)
    assert found.select("batch_id").distinct().count() >= 19
    assert found.count() == found.select("hashed_url").distinct().count() == 40
    assert len(SeenLedger(spark, path).runs()) <= stream.MERGE_EVERY + 1


# ---- what stays in the scratch folder -----------------------------------------------------------


def scratch_files(spark):
    top = spark.conf.get("spark.checkpoint.dir")
    return {os.path.join(d, f) for d, _, names in os.walk(top) for f in names}


@pytest.mark.parametrize("max_rows", [1000, 0])
def test_no_scan_leaves_plain_secrets(spark, monkeypatch, max_rows):
    from credsieve.operators import dictionary

    monkeypatch.setattr(dictionary, "BROADCAST_ROWS", max_rows)
    monkeypatch.setattr(dictionary.dictionary_match, "__defaults__", ("secret", max_rows))
    ngrams = spark.createDataFrame([("abc", 1.0), ("bcd", 2.0)], "ngram string, log_total double")
    commits = spark.createDataFrame([], "owner string, repo string, file_path string, status int, body string")
    before = scratch_files(spark)
    found = S.scan_creds(files(spark, ("f.py", 1, SECRET)), CONFIG, ngrams=ngrams, commits=commits)
    assert [(r.Secret, round(r.Dictionary_Similarity, 3)) for r in found.collect()] == [("abcd1234wxyz", 2.215)]
    left = scratch_files(spark) - before
    assert any("/staged-" in p for p in left) and any("/scores-" in p for p in left)
    assert all(b"abcd1234" not in open(p, "rb").read() for p in left)


def test_scans_store_files_with_candidates_only_and_score_many_in_place(spark, monkeypatch):
    ngrams = spark.createDataFrame([("abc", 1.0), ("bcd", 2.0)], "ngram string, log_total double")
    commits = spark.createDataFrame([], "owner string, repo string, file_path string, status int, body string")
    landed = files(spark, ("f.py", 1, SECRET), ("g.py", 1, "import os\nimport token\nnothing here\n"))

    def run(**inputs):
        before = scratch_files(spark)
        found = [tuple(r)[:9] for r in S.scan_creds(landed, CONFIG, ngrams=ngrams, **inputs).collect()]
        left = scratch_files(spark) - before
        return found, [p for p in left if p.endswith(".parquet")]

    few, left = run(commits=commits)
    staged = [p for p in left if "/staged-" in p]
    assert len(few) == 1 and sum(spark.read.parquet(f"file:{p}").count() for p in staged) == 1
    monkeypatch.setattr(S, "IN_PLACE_FILES", 0)
    many, left = run(commits=commits)
    assert few == many and any("/staged-" in p for p in left) and not any("/scores-" in p for p in left)
    bare, left = run()
    assert len(bare) == 1 and left == []


def test_sealed_columns_come_back(spark):
    schema = "k int, s string, a array<struct<x:string,y:double,z:int>>"
    rows = [(1, "plain 'text' ü\n", [("u", 0.1, 2), (None, 1e-300, None)]), (2, None, None), (3, "", [])]
    table = written(spark.createDataFrame(rows, schema), "sealed", seal=["s", "a"])
    got = sorted((r.k, r.s, r.a and [tuple(x) for x in r.a]) for r in table.collect())
    assert got == rows and dict(table.dtypes)["a"] == "array<struct<x:string,y:double,z:int>>"


def test_only_wanted_commits_are_grouped(spark):
    replies = spark.range(50).select(
        F.lit("o").alias("owner"), F.lit("r").alias("repo"), F.concat(F.lit("f"), "id").alias("file_path"),
        F.lit(200).alias("status"), F.lit("[]").alias("body"),
    )
    found = S.scan_creds(files(spark, ("f1", 1, SECRET)), CONFIG, commits=replies)
    assert found.count() == 1
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # Replies of other files are gone before any are grouped.
    assert 0 < plan.index("Aggregate") < plan.index("LeftSemi") < plan.rindex("Range")


def test_equal_secrets_are_scored_once(spark):
    rows = spark.range(3000).select(F.lit("abcabc").alias("secret"), F.col("id"))
    ngrams = spark.createDataFrame([("abc", 1.0)], "ngram string, log_total double")
    scored = dictionary_match(rows, ngrams)
    assert scored.where("match = 2.0").count() == 3000
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan  # the rows themselves are never grouped


def test_strings_of_a_row_are_sealed_together(spark):
    schema = "a string, k int, b string, c string, `d.e` int"
    rows = [("Ü\U0001f511x", 1, "", "abcd1234", 5), (None, 2, "abcd1234", None, 6), (None, 3, None, None, 7), ("-" * 10, 4, "0", "\n\x00", 8)]
    table = written(spark.createDataFrame(rows, schema), "sealed", seal=["a", "b", "c"])
    assert sorted((tuple(r) for r in table.collect()), key=lambda r: r[1]) == rows
    stored = spark.read.parquet(table.scratch_path)
    assert dict(stored.dtypes) == {"a": "binary", "k": "int", "d.e": "int"}
    assert not any(b"abcd1234" in bytes(r.a) for r in stored.collect())
    plan = table.where("b = 'abcd1234'").select("c")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aesDecrypt") == 1
