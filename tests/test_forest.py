"""The forest equals Spark ML's where both give one answer, and its work does not grow with
the trees a row is asked by or the rows that are alike."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from credsieve.operators import features, forest, ml
from credsieve.scratch import written
from tests.test_ml import labelled
from tests.test_scale import plan_of


def odd_rows(spark, n=600):
    """Detections without a rule that one feature tells; ties, unknown and missing categories."""
    kinds = F.when(F.col("id") % 7 == 0, None).when(F.col("id") % 5 == 0, "").otherwise("token")
    rows = spark.range(n).select(
        F.concat(F.lit("s"), "id").alias("Secret"),
        F.repeat(F.lit("c"), (F.col("id") % 40).cast("int")).alias("Code"),
        F.when(F.col("id") % 3 == 0, "password").otherwise(kinds).alias("Second_Key"),
        F.concat(F.lit("e"), F.col("id") % 6).alias("Extension"),
        (F.col("id") % 4).alias("Key_Weight"),
        F.round(F.rand(1) * 2, 1).alias("SKey_Count"),
        (F.rand(2) * 4).alias("Entropy"),
        F.randn(3).alias("Dictionary_Similarity"),
        (F.rand(4) * 9).alias("Score"),
    )
    real = F.col("Entropy") + F.col("Dictionary_Similarity") + F.randn(5) > 2
    return written(features.with_features(rows.withColumn("Label", real.cast("int"))), "odd")


@pytest.mark.parametrize("depth", [0, 3, 8])
def test_predictions_are_those_of_spark(spark, depth):
    rows = odd_rows(spark)
    labels = ml.categories_in(rows.where("Extension < 'e4'"))
    for model in (
        ml.pipeline(labels, trees=15, depth=depth).fit(rows),
        ml.train(rows, trees=15, depth=depth, extensions=["e0", "e1"]),
    ):
        said = ml.predict(rows, model).select("Secret", F.col("prediction").alias("said"))
        both = model.transform(rows).join(said, "Secret")
        assert both.count() == 600 and both.where("said <> prediction").isEmpty()


def test_an_even_vote_goes_to_the_first_class(spark):
    rows = odd_rows(spark, 60)
    model = ml.train(rows.withColumn("Label", F.lit(1)), trees=4)
    assert model.stages[-1].numClasses == 2
    assert ml.predict(rows, model).where("prediction <> 1").isEmpty()
    model = ml.train(rows.withColumn("Label", F.lit(0)), trees=4)
    assert ml.predict(rows, model).where("prediction <> 0").isEmpty()


def test_trees_are_no_calls_per_row(spark):
    rows = labelled(spark, 40)
    model = ml.train(features.with_features(rows), trees=3)
    kept = ml.ml_filter(rows, model)
    assert plan_of(kept).count("arrowevalpython") == 1 and "udf(struct" not in plan_of(kept)
    other = Pipeline(stages=ml.pipeline([["token"], ["py"]], 3).getStages()).fit(features.with_features(rows))
    other.stages[-1].set(other.stages[-1].thresholds, [0.9, 0.1])
    assert ml._layout(other) is None  # asked as Spark ML does


def test_equal_rows_are_counted_once(spark):
    rows = odd_rows(spark, 200).withColumn("Entropy", F.round("Entropy"))
    layout = forest.Layout(ml.NUMERIC, {"Second_Key": ["token"], "Extension": ["e0", "e1"]})
    thresholds = [np.array([0.5, 1.5])] * 9
    many = rows.withColumn("_n", F.explode(F.sequence(F.lit(1), F.lit(30)))).drop("_n")

    def groups(table):
        chunks = forest._grouped(forest._checked(table, layout), layout, thresholds).collect()
        return [
            {(a, b): c for chunk in chunks for a, b, c in zip(*(np.frombuffer(x, "int64") for x in chunk))}
        ][0]

    once, often = groups(rows), groups(many)
    assert sum(once.values()) == 200 and {k: 30 * n for k, n in once.items()} == often


def test_trees_learn_from_samples_of_all_rows(spark, monkeypatch):
    """In chunks of any size: a tree draws about as many rows as there are."""
    monkeypatch.setattr(forest, "CHUNK", 50)
    model = ml.train(odd_rows(spark), trees=40)
    roots = [t._java_obj.rootNode().impurityStats().rawCount() for t in model.stages[-1].trees]
    assert len(set(roots)) > 20 and 590 < sum(roots) / 40 < 610
    importances = model.stages[-1].featureImportances.toArray()
    assert set(np.argsort(importances)[-2:]) == {2, 3}
    again = ml.train(odd_rows(spark), trees=40).stages[-1].toDebugString
    assert again.split("\n")[1:] == model.stages[-1].toDebugString.split("\n")[1:]


def test_thresholds_are_those_of_spark(spark):
    assert forest.bins_of(np.array([3.0, 1.0, 1.0]), 32).tolist() == [2.0]
    assert forest.bins_of(np.array([2.0, 2.0]), 32).tolist() == []
    rows = odd_rows(spark, 500)
    model = ml.pipeline([["token"], ["e0"]], trees=200).fit(rows).stages[-1]
    met = {}
    for t in model.trees:
        for part in t.toDebugString.split("feature ")[1:]:
            if "<=" in part:
                feature, at = part.split(")")[0].split(" <= ")
                met.setdefault(int(feature), set()).add(float(at))
    for k, name in enumerate(ml.NUMERIC):
        own = forest.bins_of(rows.select(F.col(name).cast("double")).toPandas()[name].to_numpy(), 32)
        assert met.get(k, set()) <= set(own.tolist())
    assert len(met) > 4


def test_the_best_split_is_that_of_all(spark):
    rng = np.random.default_rng(7)
    bins, classes = [4, 2, 6], 3
    for _ in range(50):
        whole = rng.multinomial(30, rng.dirichlet(np.ones(classes)))
        cells = []
        for size in bins:
            own = np.zeros((size, classes))
            for c, n in enumerate(whole):
                own[:, c] = rng.multinomial(n, np.ones(size) / size)
            cells.append(own)

        def impurity(counts):
            return counts.sum() - (counts**2).sum() / max(counts.sum(), 1)

        gains = [
            impurity(own.sum(0)) - impurity(own[:k].sum(0)) - impurity(own[k:].sum(0))
            for own in cells
            for k in range(1, len(own))
            if own[:k].sum() and own[k:].sum()
        ]
        best, counted = forest.best_split(np.concatenate([c.ravel() for c in cells]), [0, 1, 2], bins, classes)
        assert best[0] * 30 == pytest.approx(max(gains))
        assert counted.tolist() == whole.tolist() == (best[3] + best[4]).tolist()


def test_rows_without_a_feature_are_refused(spark):
    rows = odd_rows(spark, 50)
    model = ml.train(rows, trees=3)
    for value in (None, float("nan")):
        bad = rows.withColumn("Score", F.when(F.col("Secret") == "s7", value).otherwise(F.col("Score")))
        with pytest.raises(Exception, match="lacks a feature"):
            ml.train(bad, trees=3)
        with pytest.raises(Exception, match="lacks a feature"):
            ml.predict(bad, model).collect()
