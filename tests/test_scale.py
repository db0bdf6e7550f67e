"""What keeps shuffles, tasks and files in proportion to the rows."""

import datetime
import os

from pyspark.sql import functions as F

from checks import fixtures, queries
from credsieve.operators import dictionary, features, partitioning
from credsieve.operators.partitioning import fill_cores, left_join_hot
from credsieve.scratch import written
from credsieve.sources import local_files


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString().lower()


def orders_at(spark, folder, count):
    at = datetime.datetime(1996, 1, 2)
    rows = [(k, k % 7, at + datetime.timedelta(days=k)) for k in range(1, count + 1)]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz")
    orders.write.parquet(f"{folder}/orders.parquet")


def test_only_hot_keys_of_a_large_right_side_are_repeated(spark, monkeypatch):
    monkeypatch.setattr(partitioning, "HOT_ROWS", 20)
    left = spark.createDataFrame([("a", i) for i in range(50)] + [("b", 1), (None, 2), ("c", 3)], "k string, n int")
    right = written(spark.createDataFrame([("a", 1.0), ("b", 2.0), (None, 9.0)], "k string, v double"), "right")
    joined = left_join_hot(left, right, ["k"], 0)
    assert "_hot" in plan_of(joined)
    small = left_join_hot(left, right, ["k"])
    assert sorted(map(str, joined.collect())) == sorted(map(str, small.collect()))
    assert joined.where("k is null and v is null").count() == 1


def test_pieces_that_start_like_none_of_a_large_table_leave_before_the_shuffle(spark):
    grams = [("pas", 1.0), ("pass", 2.0), ("ass", 0.5), ("0a1", 3.0), ("äöü", 4.0), ("pass", 0.25)]
    table = written(spark.createDataFrame(grams, "ngram string, log_total double"), "grams")
    secrets = ["password", "PassPass", "x0A1y", "ÄÖÜß", "zz", "", None, "password"]
    df = written(spark.createDataFrame([(s,) for s in secrets], "secret string"), "secrets")
    pieces = df.distinct().select(F.col("secret").alias("_secret"), F.lit("pas").alias("ngram"))
    plan = plan_of(dictionary._scores_shuffled(pieces, table))
    assert "leftsemi" in plan and "explode" not in plan
    large = dictionary.dictionary_match(df, table, max_rows=0)
    small = dictionary.dictionary_match(df, table)
    assert sorted(map(str, large.collect())) == sorted(map(str, small.collect()))
    found = {r.secret: r.match for r in large.collect()}
    assert found == {
        "password": 3.75, "PassPass": 7.5, "x0A1y": 3.0, "ÄÖÜß": 4.0, "zz": 0.0, "": 0.0, None: 0.0
    }


def test_secrets_are_scored_where_they_lie(spark):
    grams = [("pas", 1.0), ("pass", 2.0), ("ass", 0.5), ("0a1", 3.0), ("äöü", 4.0), ("pass", 0.25), ("a b", 8.0), (None, 9.0)]
    table = written(spark.createDataFrame(grams, "ngram string, log_total double"), "grams")
    secrets = ["password", "PassPass", "x0A1y", "ÄÖÜß", "A \t B", "\U0001f511pass", "zz", "", None, "password"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(secrets)], "id int, secret string")
    scored = dictionary.match_in_place(df, table)
    plan = plan_of(scored)
    assert "join" not in plan and "aggregate" not in plan
    assert scored.columns == ["id", "secret", "match"]
    assert sorted(scored.collect()) == sorted(dictionary.dictionary_match(written(df, "secrets"), table).collect())
    # A filter on the score does not ask for it twice.
    assert plan_of(scored.where("match > 3")).count("arrowevalpython") == 1
    assert scored.where("match > 3").count() == 6


def test_reviews_are_computed_once_and_match_whole_values(spark):
    met = spark.sparkContext.accumulator(0)

    def count(frames):
        for frame in frames:
            met.add(len(frame))
            yield frame

    kinds = "Secret string, Code string, Label int"
    review = spark.createDataFrame([("a", "b:c", 0), ("s", None, 0), ("t", "l", 0)], kinds)
    review = review.mapInPandas(count, kinds)
    rows = spark.createDataFrame([("a", "b:c", 1), ("a:b", "c", 1), ("s", None, 1), ("t", "l", 1)], kinds)
    for times, max_rows in ((1, 100), (2, 0)):
        labelled = features.apply_labels(rows, review, max_rows).collect()
        assert {(r.Secret, r.Code): r.Label for r in labelled} == {
            ("a", "b:c"): 0, ("a:b", "c"): 1, ("s", None): 1, ("t", "l"): 0
        }
        assert met.value == 3 * times


def test_a_drop_of_a_stream_may_have_many_files(spark, tmp_path, monkeypatch):
    orders_at(spark, tmp_path, 300)
    made = {}

    def new_path(session, name, *args):
        made[name] = path(session, name, *args)
        return made[name]

    path = queries.new_path
    monkeypatch.setattr(queries, "new_path", new_path)
    found = [r.hashed_url for r in queries.QUERIES["unseen_stream"](spark, str(tmp_path)).collect()]
    wanted = [r.hashed_url for r in queries._ledger_rows(spark, str(tmp_path)).collect()]
    assert sorted(found) == sorted(wanted) and len(set(wanted)) == len(wanted) > 100
    drops = made["drops"].removeprefix("file:")
    for drop in os.listdir(drops):
        assert sum(f.endswith(".parquet") for f in os.listdir(f"{drops}/{drop}")) > 1


def test_tasks_grow_in_number_not_in_rows(spark, tmp_path, monkeypatch):
    table = spark.range(100).coalesce(1)
    assert fill_cores(table, "id", 5).rdd.getNumPartitions() == 20
    assert fill_cores(table, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    orders_at(spark, tmp_path, 300)
    monkeypatch.setattr(fixtures, "FILES_A_TASK", 10)
    for files in (fixtures.code_files, fixtures.key_files):
        assert files(spark, str(tmp_path)).rdd.getNumPartitions() == 30


def test_the_files_of_a_tree_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    customer = spark.range(1, 101).selectExpr("id c_custkey", "cast(id % 3 as int) c_nationkey", "concat('C', id) c_name")
    customer.coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    asked = []

    def spread(table, key, task_rows=None):
        asked.append((key, task_rows))
        return fill_cores(table, key, task_rows)

    monkeypatch.setattr(queries, "fill_cores", spread)
    root = queries._tree(spark, str(tmp_path))
    assert asked == [("c_custkey", queries._TREE_FILES_A_TASK)]
    assert sum(len(files) for _, _, files in os.walk(root)) == 100


def test_bodies_are_read_by_as_many_tasks_as_files_need(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(local_files, "FILES_A_TASK", 2)
    for i in range(60):
        (tmp_path / f"f{i}.py").write_text(f"x = {i}\n")
    listing = local_files.list_files(spark, [str(tmp_path)], ["py"])
    bodies = local_files.read_bodies(listing).select("content", F.spark_partition_id().alias("task"))
    rows = bodies.collect()
    assert len(rows) == 60 and len({r.task for r in rows}) > 12
