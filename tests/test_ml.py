"""Features, labels, forest and its measures."""

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from credsieve import schemas
from credsieve.operators import features, ml
from credsieve.scratch import new_path


def test_features(spark):
    df = spark.createDataFrame(
        [("abc", "x = abc"), ("Ab²", ""), ("É", "é"), ("a_b", "1")], ["Secret", "Code"]
    )
    rows = features.engineer_features(df).collect()
    assert [tuple(r) for r in rows] == [(3, 7, 0, 0), (3, 0, 1, 1), (1, 1, 0, 1), (3, 1, 0, 0)]
    special = df.select(features.has_special_chars(F.col("Secret"))).collect()
    assert [r[0] for r in special] == [0, 0, 0, 1]


def test_one_hot_and_align(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], ["s", "n"])
    hot = features.one_hot(df, {"s": ["a", "c"]})
    assert hot.columns == ["n", "s_a", "s_c"]
    assert [tuple(r) for r in hot.collect()] == [(1, 1, 0), (2, 0, 0), (3, 0, 0)]
    aligned = features.align_columns(hot, ["s_c", "s_x.y", "n"])
    assert [tuple(r) for r in aligned.collect()] == [(0, 0, 1), (0, 0, 2), (0, 0, 3)]


def test_id_columns(spark):
    df = spark.createDataFrame([], schemas.struct(schemas.PUBLIC_DETECTIONS))
    left = features.drop_id_columns(df, "public").columns
    assert left == [
        "Second_Key", "Extension", "Secret", "Code", "Key_Weight", "SKey_Count", "Entropy",
        "Dictionary_Similarity", "Score", "Hour",
    ]


def test_labels(spark):
    rows = spark.createDataFrame([("s", "c", 1), ("t", "c", 1)], ["Secret", "Code", "Label"])
    review = spark.createDataFrame([("s", "c", 0), ("s", "c", 1), ("x", "y", 0)], ["Secret", "Code", "Label"])
    for max_rows in (100, 0):
        labelled = features.apply_labels(rows, review, max_rows)
        assert {r.Secret: r.Label for r in labelled.collect()} == {"s": 0, "t": 1}


def test_one_line_in_a_third_of_the_rows(spark):
    """Broadcast or salted: every copy gets its label."""
    rows = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("Secret"),
        F.lit("c").alias("Code"),
        F.col("id"),
        F.lit(1).alias("Label"),
    )
    review = spark.createDataFrame([("hot", "c", 0), ("1", "c", 0)], ["Secret", "Code", "Label"])
    for max_rows in (100, 0):
        labelled = features.apply_labels(rows, review, max_rows)
        assert labelled.count() == 6000 and labelled.where("Label = 0").count() == 2001
    plan = labelled._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan


def test_split_is_stable(spark):
    df = spark.range(5000).select("id", F.md5(F.col("id").cast("string")).alias("k"))
    train, test = features.split(df, ["k"])
    again, _ = features.split(df.repartition(7), ["k"])
    ids = {r.id for r in train.collect()}
    assert ids == {r.id for r in again.collect()}
    assert train.count() + test.count() == 5000 and 0.67 < len(ids) / 5000 < 0.73


def labelled(spark, n=400):
    return spark.range(n).select(
        F.concat(F.lit("secret"), "id").alias("Secret"),
        F.lit("code").alias("Code"),
        F.when(F.col("id") % 2 == 0, "token").otherwise("password").alias("Second_Key"),
        F.when(F.col("id") % 3 == 0, "py").otherwise("some/odd/tail").alias("Extension"),
        F.lit(5).alias("Key_Weight"),
        F.lit(1.5).alias("SKey_Count"),
        F.when(F.col("id") % 2 == 0, 3.0).otherwise(1.6).alias("Entropy"),
        F.lit(2.0).alias("Dictionary_Similarity"),
        F.lit(9.0).alias("Score"),
        (F.col("id") % 2 == 0).cast("int").alias("Label"),
    )


def test_forest_filters_and_reloads(spark):
    rows = labelled(spark)
    model = ml.train(features.with_features(rows), trees=20)
    kept = ml.ml_filter(rows, model)
    assert kept.columns == rows.columns
    assert kept.where("Label = 0").isEmpty() and kept.count() == 200
    unseen = rows.withColumns({"Second_Key": F.lit("new"), "Extension": F.lit("unseen")})
    assert ml.ml_filter(unseen, model).count() <= 400
    path = new_path(spark, "model")
    model.write().save(path)
    assert ml.ml_filter(rows, PipelineModel.load(path)).count() == 200
    scores = ml.evaluate(ml.predict(features.with_features(rows), model)).collect()[0]
    assert tuple(scores) == (1.0, 1.0, 1.0, 1.0)
    with pytest.raises(ValueError):
        ml.train(features.with_features(rows.limit(1)))


def test_a_saved_forest_filters_as_before(spark):
    rows = labelled(spark)
    model = ml.train(features.with_features(rows), trees=20)
    path = new_path(spark, "forest")
    ml.save_forest(model, path)
    loaded = ml.load_forest(spark, path, ["token", "password"], ["py", "some/odd/tail", "js"])
    odd = rows.withColumn("Extension", F.lit("never met")).withColumn("Entropy", F.rand(5) * 3)
    every = rows.unionByName(odd)
    assert sorted(ml.ml_filter(every, loaded).collect()) == sorted(ml.ml_filter(every, model).collect())
    assert ml.categories_of(loaded) == {"Second_Key": ["password", "token"], "Extension": ["py", "some/odd/tail"]}
    with pytest.raises(ValueError, match="already"):
        ml.save_forest(model, path)
    with pytest.raises(ValueError, match="Second_Key.*token"):
        ml.load_forest(spark, path, ["password"])
    with pytest.raises(ValueError, match="Extension"):
        ml.load_forest(spark, path, extensions=["py"])
    other = ml.train(features.with_features(rows.where("Second_Key = 'token' or Entropy > 9").unionByName(
        rows.where("Second_Key = 'password'").withColumn("Second_Key", F.lit("pin")))), trees=2)
    ml.save_forest(other, path, overwrite=True)
    assert ml.categories_of(ml.load_forest(spark, path))["Second_Key"] == ["pin", "token"]


def test_a_forest_folder_is_checked(spark, monkeypatch):
    rows = features.with_features(labelled(spark, 40))
    model, path = ml.train(rows, trees=2), new_path(spark, "forest")
    with pytest.raises(ValueError, match="no complete forest"):
        ml.load_forest(spark, path)
    model.write().save(f"{path}/{ml.STAGES}")  # the save broke off here
    with pytest.raises(ValueError, match="no complete forest"):
        ml.load_forest(spark, path)
    ml.save_forest(model, path, overwrite=True)
    ml.train(rows.withColumn("Second_Key", F.lit("x")), trees=2).write().overwrite().save(f"{path}/{ml.STAGES}")
    with pytest.raises(ValueError, match="differ"):
        ml.load_forest(spark, path)
    ml.save_forest(model, path, overwrite=True)
    monkeypatch.setattr(ml, "NUMERIC", ml.NUMERIC[:-1])
    with pytest.raises(ValueError, match="computes"):
        ml.load_forest(spark, path)


def test_categories_are_the_values_present(spark):
    rows = spark.createDataFrame(
        [("a", "x")] * 3 + [("b", "y")] * 2 + [("c", "z")] * 2 + [(None, ""), ("d", "x")],
        ["Second_Key", "Extension"],
    )
    assert ml.categories_in(rows) == [["a", "b", "c", "d"], ["x", "y", "z"]]
    assert ml.categories_in(rows, most=2) == [["a", "b"], ["x", "y"]]
    assert ml.categories_in(rows, keywords=("b", "q"), extensions=()) == [["b"], [""]]
    hot = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("Second_Key"),
        F.lit("x").alias("Extension"),
    )
    first, _ = ml.categories_in(hot, most=50)
    assert len(first) == 50 and "hot" in first


def test_measures(spark):
    rows = [(1, 1.0)] * 3 + [(1, 0.0)] * 1 + [(0, 1.0)] * 2 + [(0, 0.0)] * 4
    got = ml.evaluate(spark.createDataFrame(rows, ["Label", "prediction"])).collect()[0]
    assert tuple(got) == pytest.approx((0.7, 0.6, 0.75, 2 / 3))
    none = ml.evaluate(spark.createDataFrame([(0, 0.0)], ["Label", "prediction"])).collect()[0]
    assert tuple(none) == (1.0, 0.0, 0.0, 0.0)


def test_a_run_with_a_model_reports_what_the_model_leaves_out(spark):
    from credsieve.plans.job import run_scan
    from credsieve.plans.scan import ScanConfig

    url = "https://git.example.com/o/r/blob/main/"
    secrets = [f"abcd{k}wxyz" if k % 2 else f"ABCD{k}WXYZ" for k in range(40)]
    rows = [(k, f"{url}f{k}.py", f"a\ntoken = {s}\nb\n") for k, s in enumerate(secrets)]
    files = spark.createDataFrame(rows, "file_id long, html_url string, content string")
    files = files.withColumn("indexed_at", F.timestamp_seconds(F.lit(0)))
    config = ScanConfig(keywords=("token",), keep_secret=True)
    plain = run_scan(files, config)["detections"]
    labelled = plain.withColumn("Label", (F.col("Secret") != F.upper("Secret")).cast("int"))
    model = ml.train(features.with_features(labelled), trees=20)
    out = run_scan(files, config, model=model)
    assert out["detections"].columns == plain.columns
    assert {r.Secret for r in out["detections"].collect()} == {s for s in secrets if s.islower()}
    total = out["report"].where("Extension is null and Query is null").first()
    assert (total.Detections, total.Writes) == (40, 20)
