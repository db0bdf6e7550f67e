"""Lists, local files, sinks and streams."""

import os

import pytest
from pyspark.sql import functions as F

from checks import fixtures as X
from credsieve import resources as R
from credsieve import schemas
from credsieve.operators.commits import attach_commits, format_commits, stamp
from credsieve.operators.ledger import drop_seen_files, file_ledger_rows
from credsieve.operators.queries import (
    enterprise_queries,
    newest_first,
    public_queries,
    scope_filter,
    search_pairs,
)
from credsieve.operators.weights import key_weight, unweighted_keywords
from credsieve.plans.file_scan import run_file_scan, scan_files
from credsieve.plans.scan import ScanConfig, scan_creds
from credsieve.scratch import new_path, scratch_dir
from credsieve.sinks import tables
from credsieve.sources import lists, local_files
from credsieve.streaming import stream


def values(df):
    return [r[0] for r in df.collect()]


def test_lists_from_files(spark, tmp_path):
    path = tmp_path / "words.csv"
    path.write_bytes(b"\xef\xbb\xbfprimary_keys\nOne\n\ntwo \ntwo \nOne\n")
    assert values(lists.read_keywords(spark, str(path), "primary")) == ["One", "two ", "two ", "One"]
    assert values(lists.read_stop_words(spark, str(path)))[1] == "two "
    header_only = tmp_path / "empty.csv"
    header_only.write_text("primary_keys\n\n")
    assert values(lists.read_keywords(spark, str(header_only), "primary")) == []
    assert values(lists.read_keywords(spark, str(tmp_path / "none.csv"))) == []
    with pytest.raises(ValueError):
        lists.read_dictionary(spark, str(header_only))
    with pytest.raises(ValueError):
        lists.read_confidence(spark, str(header_only))


def test_default_lists(spark):
    assert len(values(lists.read_keywords(spark))) == 75
    assert values(lists.read_keywords(spark)).count("password") == 2
    assert len(values(lists.read_keywords(spark, kind="keys"))) == 66
    assert len(values(lists.read_extensions(spark))) == 49
    assert len(values(lists.read_stop_words(spark))) == 60
    assert sum(w.endswith(" ") for w in R.STOP_WORDS) == 15
    weights = {r.key: r.value for r in lists.read_confidence(spark).collect()}
    assert len(weights) == 145 and set(weights.values()) == {1, 2, 3, 4, 5}
    missing = unweighted_keywords(lists.read_keywords(spark), lists.read_confidence(spark))
    assert set(values(missing)) == {"ci_deploy_password", "twine_password"}


def test_long_lists_are_refused(spark, monkeypatch):
    monkeypatch.setattr(lists, "MAX_LIST", 3)
    assert lists.list_values(spark.range(3)) == [0, 1, 2]
    with pytest.raises(ValueError):
        lists.list_values(spark.range(4))


def test_weights_default_to_zero(spark):
    df = spark.createDataFrame([("token", "py"), ("nope", "Makefile"), ("key", "key")], ["kw", "ext"])
    got = {r.kw: r.Key_Weight for r in key_weight(df, lists.read_confidence(spark)).collect()}
    assert got == {"token": 10, "nope": 0, "key": 2}


def test_queries(spark):
    words = spark.createDataFrame([("a b",), ("c",)], ["keyword"])
    assert values(public_queries(["P", None, " "], words).select("query")) == ["P a b", "P c"]
    assert values(public_queries([], words).select("query")) == ["a b", "c"]
    queries = enterprise_queries(words)
    assert values(queries.select("query")) == ['"a b"', '"c"']
    assert search_pairs(queries, ["py", "js", "others"]).count() == 6


def test_scope(spark):
    rows = [(f"https://h/{o}/{r}/blob/m/f", i) for i, (o, r) in enumerate([("a", "x"), ("a", "y"), ("b", "x")])]
    files = spark.createDataFrame(rows, ["html_url", "i"])
    assert values(scope_filter(files, ["a"], ["b/x"]).select("i")) == [0, 1]
    assert values(scope_filter(files, [], ["b/x", "a/y"]).select("i")) == [1, 2]
    assert scope_filter(files).count() == 3


def test_newest_first(spark):
    df = spark.sql("select id, timestamp_seconds(id) indexed_at, 'u' html_url from range(5)")
    assert values(newest_first(df)) == [4, 3, 2, 1, 0]
    assert values(newest_first(df, limit=2)) == [4, 3]


def tree(root):
    for name, text in {
        "a.py": "token = 'abcd12345'\n\nx\n",
        "x/.gitignore": "1",
        "x/a.PY": "2",
        "x/a.tar.py": "3",
        "x/.hidden/__init__.py": "4\r\nfive",
        "x/_y/.b.py": "5",
        "x/noext": "6",
    }.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text.encode())
    (root / "bad.py").write_bytes(b"\xff\xfe\xfa")
    (root / "dir.py").mkdir()
    os.symlink(root, root / "x" / "loop")
    return str(root)


def test_listing(spark, tmp_path):
    root = tree(tmp_path)
    found = local_files.list_files(spark, [root, f"{root}/x/noext", f"{root}/none"], ["gitignore", "py"])
    names = sorted(os.path.relpath(p, root) for p in values(found.select("path")))
    assert names == sorted(
        ["a.py", "bad.py", "x/a.tar.py", "x/.hidden/__init__.py", "x/_y/.b.py", "x/noext"]
    )
    bodies = {os.path.relpath(r.path, root): r.content for r in local_files.read_local_code(found).collect()}
    assert bodies["bad.py"] == "" and bodies["x/.hidden/__init__.py"] == "4\nfive"


def test_changed_files_are_scanned_again(spark, tmp_path):
    root = tree(tmp_path)
    first = local_files.list_files(spark, [root], ["py"])
    seen = spark.createDataFrame(file_ledger_rows(first).collect())
    assert drop_seen_files(first, seen).isEmpty()
    os.utime(tmp_path / "a.py", (1, 1))
    again = drop_seen_files(local_files.list_files(spark, [root], ["py"]), seen)
    assert [os.path.basename(p) for p in values(again.select("path"))] == ["a.py"]


def test_file_scan(spark, tmp_path):
    root = tree(tmp_path)
    found = scan_files(spark, [root], ["py"], ScanConfig(keywords=("token",))).collect()
    assert [(r.Second_Key, r.Code, r.URL) for r in found] == [
        ("token", "token ='abc##########", f"{root}/a.py")
    ]


def test_second_file_scan_reads_changed_files_only(spark, tmp_path):
    root, config = tree(tmp_path), ScanConfig(keywords=("token",))
    first = run_file_scan(spark, [root, f"{root}/none"], ["py"], config)
    unread = {os.path.relpath(r.path, root) for r in first["unreadable"].collect()}
    assert unread == {"none", "bad.py"}
    listed = {os.path.relpath(p, root) for p in values(first["ledger"].select("files"))}
    assert listed == {"a.py", "x/a.tar.py", "x/.hidden/__init__.py", "x/_y/.b.py"}
    assert first["detections"].count() == 1
    again = run_file_scan(spark, [root], ["py"], config, first["ledger"])
    assert again["detections"].isEmpty() and again["ledger"].isEmpty()
    os.utime(tmp_path / "a.py", (1, 1))
    again = run_file_scan(spark, [root], ["py"], config, first["ledger"])
    assert again["detections"].count() == again["ledger"].count() == 1


def test_file_scan_leaves_no_plain_secret(spark, tmp_path):
    def scratch():
        top = spark.conf.get("spark.checkpoint.dir")
        return {os.path.join(d, f) for d, _, names in os.walk(top) for f in names}

    root, before = tree(tmp_path), scratch()
    assert run_file_scan(spark, [root], ["py"], ScanConfig(keywords=("token",)))["detections"].count()
    secret = b"abcd12345"
    assert secret in (tmp_path / "a.py").read_bytes()
    assert all(secret not in open(p, "rb").read() for p in scratch() - before)


def test_append_checked(spark, tmp_path):
    a = spark.createDataFrame([(1, "x")], ["n", "s"])
    for fmt in ("parquet", "csv"):
        path = str(tmp_path / fmt)
        tables.append_checked(a, path, fmt)
        tables.append_checked(a, path, fmt)
        assert spark.read.format(fmt).option("header", True).load(path).count() == 2
        for wrong in (a.select("n"), a.select("s", "n"), a.withColumnRenamed("s", "t")):
            with pytest.raises(ValueError):
                tables.append_checked(wrong, path, fmt)
        tables.overwrite(a.select("n"), path, fmt)
        assert spark.read.format(fmt).option("header", True).load(path).columns == ["n"]


def test_ledger_parts(spark, tmp_path):
    rows = spark.createDataFrame([("h1", "u1")], schemas.URL_LEDGER)
    path = str(tmp_path / "ledger")
    assert lists.read_url_ledger(spark, path).isEmpty()
    tables.append_ledger(rows, path, "public", "keys", "ml")
    tables.append_ledger(rows, path, "public", "creds", "plain")
    part = spark.read.parquet(path).where("kind = 'keys'")
    assert part.count() == 1 and lists.read_url_ledger(spark, path).count() == 2
    parts = lists.read_file_ledger(spark, str(tmp_path / "none"))
    assert all(p.isEmpty() for p in parts.values())


def test_scratch_needs_a_folder(spark):
    other = spark.newSession()
    if other.conf.get("spark.checkpoint.dir", None):
        assert scratch_dir(other)
        return
    with pytest.raises(ValueError):
        scratch_dir(other)


def test_commit_json(spark):
    bodies = [
        ("ok", 200, '[{"sha":"s","commit":{"author":{"email":"e","name":"n","date":"d"}},"author":{"login":"l"}}]'),
        ("gaps", 200, '[{"commit":{"author":{"name":"n"}},"author":null},{}]'),
        ("none", 200, "[]"),
        ("missing", 404, "[]"),
        ("broken", 200, "not json"),
    ]
    df = spark.createDataFrame(bodies, "k string, status int, body string")
    got = {r.k: r.v for r in df.select("k", format_commits(F.col("status"), F.col("body")).alias("v")).collect()}
    assert got["ok"] == (
        '{"status":200,"commits":[{"commit_id":"s","email":"e","commiter_name":"n","commit_date":"d","user_id":"l"}]}'
    )
    blank = '{"commit_id":"","email":"","commiter_name":"%s","commit_date":"","user_id":""}'
    assert got["gaps"] == '{"status":200,"commits":[%s,%s]}' % (blank % "n", blank % "")
    assert got["none"] == '{"status":200,"commits":[]}'
    assert got["missing"] == got["broken"] == "{}"


def test_commits_do_not_multiply_rows(spark):
    df = spark.createDataFrame([("o", "r", "p", 1), ("o", "r", "q", 2)], ["owner", "repo", "file_path", "i"])
    replies = [("o", "r", "p", 404, "[]"), ("o", "r", "p", 200, "[]"), ("o", "r", "p", 200, "[]")]
    found = attach_commits(df, spark.createDataFrame(replies, schemas.COMMITS_RAW))
    assert sorted((r.i, r.Commit_Details) for r in found.collect()) == [
        (1, '{"status":200,"commits":[]}'), (2, "{}"),
    ]


def test_stamp(spark):
    row = stamp(spark.range(1), "2024-02-03 04:05:06").collect()[0]
    assert row.Detected_Timestamp == "2024-02-03 04:05:06"
    assert (row.Year, row.Month, row.Day, row.Hour) == (2024, 2, 3, 4)


def orders(spark, low, high):
    return spark.range(low, high).select(
        F.col("id").alias("o_orderkey"),
        (F.col("id") % 97).alias("o_custkey"),
        F.timestamp_seconds(F.col("id") * 3600).alias("o_orderdate"),
    )


CONFIG = ScanConfig(keywords=X.CORE_KEYWORDS)


def test_stream_in_drops_equals_batch(spark):
    """Four drops, one of them landed again, a replayed batch: the batch result."""
    landing, found, seen, state = (new_path(spark, n) for n in ("land", "found", "seen", "state"))
    for i, (low, high) in enumerate([(1, 60), (60, 120), (60, 120), (120, 200)]):
        orders(spark, low, high).coalesce(1).write.mode("append").parquet(landing)
        source = spark.readStream.schema(orders(spark, 0, 1).schema).parquet(landing)
        stream.scan_stream(X.code_files_of(source), CONFIG, found, seen, state).awaitTermination()
    batch = scan_creds(X.code_files_of(orders(spark, 1, 200)), CONFIG)
    streamed = spark.read.parquet(found).select(*batch.columns)
    assert sorted(map(str, streamed.collect())) == sorted(map(str, batch.collect()))
    # the last batch run again: its commit is lost, its outputs are there
    commits_path = os.path.join(state.removeprefix("file:"), "commits")
    last = max(int(n) for n in os.listdir(commits_path) if n.isdigit())
    for name in (str(last), f".{last}.crc"):
        if os.path.exists(os.path.join(commits_path, name)):
            os.remove(os.path.join(commits_path, name))
    source = spark.readStream.schema(orders(spark, 0, 1).schema).parquet(landing)
    stream.scan_stream(X.code_files_of(source), CONFIG, found, seen, state).awaitTermination()
    replayed = spark.read.parquet(found).select(*batch.columns)
    assert sorted(map(str, replayed.collect())) == sorted(map(str, batch.collect()))


def test_windows_stream_equals_batch(spark):
    landing, out, state = (new_path(spark, n) for n in ("land", "out", "state"))
    rows = spark.range(0, 400).select(
        F.timestamp_seconds(F.col("id") * 900).alias("indexed_at"),
        F.lit("creds").alias("kind"),
        (F.col("id") % 3).cast("string").alias("owner"),
    )
    rows.coalesce(1).write.parquet(landing)
    source = spark.readStream.schema(rows.schema).parquet(landing)
    windows = stream.detections_per_window(source, delay="2 hours")
    query = windows.writeStream.option("checkpointLocation", state).trigger(availableNow=True)
    query.format("parquet").option("path", out).start().awaitTermination()
    end = F.timestamp_seconds(F.lit(399 * 900 - 7200))
    closed = stream.detections_per_window(rows).where(F.col("window_end") <= end)
    assert sorted(map(str, spark.read.parquet(out).collect())) == sorted(map(str, closed.collect()))


def test_stream_drops_repeats(spark):
    landing, out, state = (new_path(spark, n) for n in ("land", "out", "state"))
    rows = spark.range(0, 90).select(
        F.timestamp_seconds("id").alias("indexed_at"),
        F.md5((F.col("id") % 30).cast("string")).alias("hashed_url"),
    )
    rows.coalesce(1).write.parquet(landing)
    source = spark.readStream.schema(rows.schema).parquet(landing)
    query = stream.drop_seen_stream(source).writeStream.option("checkpointLocation", state)
    query.trigger(availableNow=True).format("parquet").option("path", out).start().awaitTermination()
    assert spark.read.parquet(out).count() == 30
