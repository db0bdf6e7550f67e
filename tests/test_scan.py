"""Whole scans: against a row model, under skew, again with their ledger."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from checks import fixtures as X
from credsieve import resources as R
from credsieve import schemas
from credsieve.functions.score import MIN_ENTROPY
from credsieve.operators.dictionary import build_ngram_table, dictionary_match
from credsieve.operators.ledger import drop_seen, latest_per_url, unique_detections
from credsieve.operators.queries import found_words, keyword_match, word_families
from credsieve.plans import scan as S
from credsieve.plans.job import run_scan
from tests import rowmodel

FILE_COLUMNS = "file_id long, html_url string, indexed_at timestamp, content string"


def random_files(n, seed):
    rnd = random.Random(seed)
    alnum = "abcdefABCDEF0123456789"

    def word(k):
        return "".join(rnd.choice(alnum) for _ in range(k))

    def piece():
        return rnd.choice(
            [
                lambda: rnd.choice(R.SECONDARY_CREDS),
                lambda: rnd.choice(R.SECONDARY_KEYS).upper(),
                lambda: rnd.choice(["TOKEN", "Password", "awsSecretKey", "api-key", "uuid", "www"]),
                lambda: rnd.choice([":", "=", " = ", ": ", " := ", '"', "'", ",", "/", "0x", "\t", "\r"]),
                lambda: word(rnd.choice([3, 6, 7, 8, 12, 20, 24, 40, 41, 64])),
                lambda: word(8) + rnd.choice("$^_@!+é") + word(3),
                lambda: "AKIA" + word(16).upper(),
                lambda: "xoxb-" + "-".join(["123456789012"] * 3) + "-" + "a1" * 16,
                lambda: f"http://{word(4)}.example.com/{word(5)}?q={word(2)}",
                lambda: f"{word(4)}@mail.{word(3)}.org",
                lambda: f"{word(4)}.example.net/{word(9)}",
                lambda: rnd.choice(["static1", "changeme", "x" * 320, "self.id", "BEGIN RSA PRIVATE KEY"]),
            ]
        )()

    files = []
    for i in range(n):
        lines = [
            "".join(piece() + rnd.choice([" ", " ", "", "="]) for _ in range(rnd.randint(0, 9)))
            for _ in range(rnd.randint(1, 9))
        ]
        ext = rnd.choice(["py", "md", "js", "txt", "zzz"])
        url = f"https://git.example.com/o{i % 5}/r{i % 3}/blob/main/d/f{i}.{ext}"
        files.append((i, url, None, "\n".join(lines)))
    return files


@pytest.mark.parametrize("kind", ["creds", "keys"])
def test_scan_equals_row_model(spark, kind):
    rows = random_files(4000, seed=11 if kind == "creds" else 12)
    config = S.ScanConfig(kind=kind)
    expected = {
        (i, kw, secret, *rest)
        for i, url, _, content in rows
        for (kw, secret), rest in rowmodel.scan(
            content, url.rsplit(".", 1)[-1], config.words, kind
        ).items()
    }
    staged = S.stage_files(spark.createDataFrame(rows, FILE_COLUMNS), config)
    found = S.candidate_hits(staged, config).select(
        "file_id", "kw", "secret", "line", "n", F.round("entropy", 6).alias("e")
    )
    assert {tuple(r) for r in found.collect()} == expected
    assert len(expected) > 1000


def corpus(spark, n=300):
    orders = spark.range(1, n + 1).select(
        F.col("id").alias("o_orderkey"),
        (F.col("id") % 97).alias("o_custkey"),
        F.timestamp_seconds(F.col("id") * 86400).alias("o_orderdate"),
    )
    return X.code_files_of(orders)


CONFIG = S.ScanConfig(keywords=X.CORE_KEYWORDS, site_host=X.SITE_HOST, raw_host=X.RAW_HOST)


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_schemas_hide_the_secret(spark):
    files = corpus(spark)
    commits = spark.createDataFrame([], schemas.COMMITS_RAW)
    enterprise = S.scan_creds(files, CONFIG, commits=commits)
    assert enterprise.columns == [c for c in schemas.ENTERPRISE_DETECTIONS if c != "Secret"]
    public = S.scan_creds(files, replace(CONFIG, source="public", primary=("import",)), commits=commits)
    assert public.columns == [c for c in schemas.PUBLIC_DETECTIONS if c != "Secret"]
    training = S.collect_training(files, CONFIG)
    assert training.columns == schemas.TRAINING_SOURCE
    types = dict(enterprise.dtypes)
    assert types["Key_Weight"] == "int" and types["Score"] == "double" and types["Year"] == "int"
    assert enterprise.where("Commit_Details <> '{}'").isEmpty()


def test_masked_code_never_holds_the_secret(spark):
    rows = random_files(1500, seed=5)
    for kind in ("creds", "keys"):
        config = S.ScanConfig(kind=kind, keep_secret=True)
        found = S.scan(spark.createDataFrame(rows, FILE_COLUMNS), config)
        assert not found.isEmpty()
        assert found.where(F.contains("Code", "Secret")).isEmpty()
        assert found.where(F.col("Entropy") <= MIN_ENTROPY).isEmpty()


def test_gates_are_parameters_and_leave_a_count(spark):
    url = "https://git.example.com/o/r/blob/main/"
    many = "token = abcd1234\n" + "\n".join(f"v = wxyz{k}987" for k in range(30)) + "\n"
    rows = [(1, url + "many.py", many), (2, url + "two.txt", "token = abcd1234\n"), (3, url + "none.js", "a\nb\nc\n")]
    rows.append((4, url + "long.yml", "token = " + "x " * 200 + "abcd1234\n\n\n"))
    files = spark.createDataFrame(rows, "file_id long, html_url string, content string")
    files = files.withColumn("indexed_at", F.timestamp_seconds(F.lit(0)))
    config = S.ScanConfig(keywords=("token",), keep_secret=True)

    def found(config):
        out = run_scan(files, config)
        names = {r.URL.rsplit("/", 1)[1] for r in out["detections"].collect()}
        return names, {r.Extension: r.Files for r in out["stopped"].collect()}

    assert found(config) == (set(), {"py": 1, "txt": 1})
    wide = replace(config, max_candidates=100, min_lines=2, max_line=1000)
    assert found(wide) == ({"many.py", "two.txt", "long.yml"}, {})
    assert found(replace(wide, min_entropy=9.0)) == (set(), {})
    assert S.search_id(config) != S.search_id(wide) == S.search_id(replace(wide))


def test_second_run_finds_nothing_new(spark):
    first = run_scan(corpus(spark), CONFIG)
    again = run_scan(corpus(spark), CONFIG, ledger=first["ledger"])
    assert first["detections"].count() > 0
    assert again["detections"].isEmpty()
    assert again["ledger"].isEmpty()
    totals = first["report"].where("Extension is null and Query is null").collect()[0]
    assert totals.Detections == totals.Writes == first["detections"].count()


def test_ledger_way_equals_plain_way(spark):
    words = spark.createDataFrame([("password",), ("abcdef",), ("static",)], ["dic_word"])
    ngrams = build_ngram_table(words)
    empty = spark.createDataFrame([], schemas.struct(schemas.URL_LEDGER))
    files = corpus(spark)
    plain = S.scan_creds(files, CONFIG, ngrams=ngrams)
    assert rows_of(S.scan_creds(files, CONFIG, ngrams=ngrams, ledger=empty)) == rows_of(plain)


def test_ledger_keeps_source_queries_apart(spark):
    """The fingerprint holds the query: a new keyword scans known files again."""
    seen = run_scan(corpus(spark), replace(CONFIG, keywords=("token",)))["ledger"]
    both = replace(CONFIG, keywords=("token", "auth_token"))
    found = S.scan_creds(corpus(spark), both, ledger=seen)
    assert {r.Second_Key for r in found.collect()} == {"auth_token"}


def test_newest_version_of_a_url(spark):
    old, new = "a\ntoken = abcd1234\n", "a\ntoken = wxyz9876\n"
    url = "https://git.example.com/o/r/blob/main/f.py"
    rows = [(1, url, "2024-01-02", new), (2, url, "2024-01-01", old)]
    files = spark.createDataFrame(rows, "file_id long, html_url string, t string, content string")
    files = files.select("file_id", "html_url", F.to_timestamp("t").alias("indexed_at"), "content")
    config = S.ScanConfig(keywords=("token",), unmask=True)
    assert [r.Code for r in S.scan_creds(files, config).collect()] == ["token = wxyz9876"]
    assert S.scan_creds(files, replace(config, dedupe=False)).count() == 2


def test_one_url_landed_very_often(spark):
    """The rank filter runs before the shuffle, so a hot URL is one row per task."""
    rows = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("html_url"),
        F.timestamp_seconds("id").alias("indexed_at"),
        F.col("id").alias("file_id"),
    )
    latest = latest_per_url(rows)
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert latest.count() == 20001
    assert latest.where("html_url = 'hot'").collect()[0].file_id == 29997


def test_files_match_without_a_join_or_shuffle(spark):
    plan = S.stage_files(corpus(spark), replace(CONFIG, dedupe=False))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Join" not in text


def test_primary_keywords_are_one_job(spark):
    config = replace(CONFIG, source="public", primary=("import", None, " ", "mail"))
    both = S.scan_creds(corpus(spark), config)
    parts = [
        S.scan_creds(corpus(spark), replace(config, primary=(p,))) for p in ("import", "mail")
    ]
    assert rows_of(both) == rows_of(parts[0].unionByName(parts[1]))


def test_public_scan_without_primary_keyword(spark):
    config = replace(CONFIG, source="public")
    found = S.scan_creds(corpus(spark), config)
    assert found.where("Primary_Key is not null").isEmpty()
    assert found.count() == S.scan_creds(corpus(spark), CONFIG).count()
    assert S.with_fingerprint(
        spark.sql("select 'https://git.example.com/o/r/blob/m/f' html_url, 'k' kw, string(null) primary"),
        config,
    ).collect()[0].query == "k"


def test_families_hold_every_word():
    for words in (R.SECONDARY_CREDS, R.SECONDARY_KEYS, ("b", "ab", "B", "abc")):
        families = word_families(words)
        assert sorted(w for f in families.values() for w in f) == sorted(set(words))
        assert all(short in w.lower() for short, f in families.items() for w in f)


def test_found_words_ignores_case_and_repeats(spark):
    df = spark.createDataFrame([("Token TOKENS api_KEY",), ("none",)], ["t"])
    found = df.select(found_words(F.col("t"), ["token", "KEY", "token", "nope"]).alias("f")).collect()
    assert sorted((x.kw, x.n) for x in found[0].f) == [("KEY", 1), ("token", 2)]
    assert found[1].f == []


def test_listed_twice_is_searched_twice(spark):
    files = spark.createDataFrame([(1, "http://h/o/r/b/m/f.py", None, "token")], FILE_COLUMNS)
    pairs = keyword_match(files, ["token", "token"], extensions=["py", "others", "js"])
    assert [r.search_extension for r in pairs.orderBy("search_extension").collect()] == [
        "others", "others", "py", "py",
    ]


def test_dictionary_both_ways(spark):
    words = spark.createDataFrame([(w,) for w in ("Password", "passage", "sword", "wordy")], ["dic_word"])
    ngrams = build_ngram_table(words)
    table = {r.ngram: (r.total, r.doc_freq) for r in ngrams.collect()}
    assert table["wor"] == (3, 3) and table["pass"] == (2, 2) and table["rdy"] == (1, 1)
    secrets = spark.createDataFrame(
        [(i, s) for i, s in enumerate(["password1", "zzz", "ab", "PASSWORD1"] + ["passage"] * 50)],
        ["id", "secret"],
    )
    small = dictionary_match(secrets, ngrams)
    large = dictionary_match(secrets, ngrams, max_rows=0)
    assert small.count() == large.count() == 54
    joined = small.alias("a").join(large.alias("b"), "id").where("abs(a.match - b.match) < 1e-9")
    assert joined.count() == 54
    got = {r.secret: r.match for r in small.collect()}
    assert got["zzz"] == got["ab"] == 0 and got["password1"] == got["PASSWORD1"] > 0


def test_unique_detections_keeps_the_best(spark):
    row = "'s' Source, 'k' Second_Key, 'py' Extension, 'u' URL, 'c' Code, '1' Detected_Timestamp"
    df = spark.sql(f"select {row}, 2.0D Score union all select {row}, 3.0D union all select {row}, 1.0D")
    assert [r.Score for r in unique_detections(df).collect()] == [3.0]


def test_drop_seen_with_a_hot_fingerprint(spark):
    rows = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.md5(F.col("id").cast("string"))).alias("hashed_url")
    )
    seen = spark.createDataFrame([("hot",)], ["hashed_url"])
    assert drop_seen(rows, seen).count() == 6000
