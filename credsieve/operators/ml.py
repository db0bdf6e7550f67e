"""Random forest that tells real secrets from false positives."""

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, OneHotEncoderModel, StringIndexerModel, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credsieve.operators import forest
from credsieve.operators.features import CATEGORICAL, NUMERIC, with_features
from credsieve.scratch import exists, remove, written

TREES = 500
DEPTH = 3


#: Values of a category column that get a feature of their own, the most frequent ones;
#: all others share one. The list passes through the driver, so it has a bound.
MOST_CATEGORIES = 4096

ABOUT, STAGES = "about", "stages"


def categories_in(training: DataFrame, keywords=None, extensions=None, most=MOST_CATEGORIES) -> list:
    """The values of each category column in the training rows, counted where the rows are;
    of more than ``most`` values the frequent ones, ties by value.

    ``keywords`` and ``extensions``, if given, are the only values that count.
    """
    present = []
    for column, own in zip(CATEGORICAL, (keywords, extensions)):
        rows = training.where(F.col(column).isNotNull() & (F.col(column) != ""))
        if own is not None:
            rows = rows.where(F.col(column).isin(list(own)))
        counted = rows.groupBy(column).agg(F.count("*").alias("n"))
        met = counted.orderBy(F.desc("n"), column).limit(most).collect()
        present.append(sorted(row[0] for row in met) or [""])
    return present


def pipeline(labels, trees=TREES, depth=DEPTH, seed=123) -> Pipeline:
    """Category encoding by the given labels, assembly and forest."""
    indexed = [f"{c}_index" for c in CATEGORICAL]
    dummies = [f"{c}_dummies" for c in CATEGORICAL]
    indexers = [
        StringIndexerModel.from_labels(values, column, index, handleInvalid="keep")
        for values, column, index in zip(labels, CATEGORICAL, indexed)
    ]
    return Pipeline(
        stages=[
            *indexers,
            OneHotEncoder(
                inputCols=indexed, outputCols=dummies, dropLast=False, handleInvalid="keep"
            ),
            VectorAssembler(inputCols=[*NUMERIC, *dummies], outputCol="features"),
            RandomForestClassifier(
                labelCol="Label", featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed
            ),
        ]
    )


def train(training: DataFrame, trees=TREES, depth=DEPTH, seed=123, **categories) -> PipelineModel:
    """Fit on labelled training rows with features; two rows are the minimum.

    The columns that a forest learns from are written once, as they are read several times;
    secrets and lines are not among them.
    """
    rows = written(training.select(*NUMERIC, *CATEGORICAL, "Label"), "training-rows")
    if rows.limit(2).count() < 2:
        raise ValueError("training needs at least two rows")
    labels = categories_in(rows, **categories)
    *encoding, classifier = pipeline(labels, trees, depth, seed).getStages()
    encoded = Pipeline(stages=encoding).fit(rows)
    fitted = forest.fit(rows, forest.Layout(NUMERIC, dict(zip(CATEGORICAL, labels))), classifier)
    return PipelineModel([*encoded.stages, fitted])


def categories_of(model: PipelineModel) -> dict:
    """The values of each category column that a forest knows."""
    return {s.getInputCol(): list(s.labels) for s in model.stages if isinstance(s, StringIndexerModel)}


def save_forest(model: PipelineModel, path: str, overwrite=False) -> None:
    """Keep a trained forest in a folder: its stages, as Spark ML writes them, and the
    features and categories it expects. The latter come last, so a folder that was not
    written to the end is not taken for a forest."""
    spark = SparkSession.getActiveSession()
    if not overwrite and exists(spark, path):
        raise ValueError(f"{path} is there already")
    remove(spark, f"{path}/{ABOUT}")
    model.write().overwrite().save(f"{path}/{STAGES}")
    rows = [("numeric", "", i, name) for i, name in enumerate(NUMERIC)]
    for column, values in categories_of(model).items():
        rows += [("category", column, i, value) for i, value in enumerate(values)]
    about = spark.createDataFrame(rows, "kind string, column string, place int, value string")
    about.coalesce(1).write.mode("overwrite").parquet(f"{path}/{ABOUT}")


def load_forest(spark: SparkSession, path: str, keywords=None, extensions=None) -> PipelineModel:
    """A forest kept by ``save_forest``.

    Refused if it was trained on other features than this version computes, if its stages
    and their description differ, or, given the ``keywords`` and ``extensions`` of the scan
    it is to filter, if it has learnt from others: detections of a scan with another
    list would all fall into the category of unknown values.
    """
    if not exists(spark, f"{path}/{ABOUT}/_SUCCESS"):
        raise ValueError(f"{path} holds no complete forest")
    rows = spark.read.parquet(f"{path}/{ABOUT}").orderBy("kind", "column", "place").collect()
    numeric = [r.value for r in rows if r.kind == "numeric"]
    if numeric != NUMERIC:
        raise ValueError(f"{path} was trained on {numeric}, this version computes {NUMERIC}")
    model = PipelineModel.load(f"{path}/{STAGES}")
    described = {c: [r.value for r in rows if (r.kind, r.column) == ("category", c)] for c in CATEGORICAL}
    if categories_of(model) != described:
        raise ValueError(f"the stages and the description in {path} differ")
    for column, allowed in zip(CATEGORICAL, (keywords, extensions)):
        strange = [] if allowed is None else sorted({*described[column]} - {"", *allowed})
        if strange:
            raise ValueError(f"{path} was trained with other values of {column}: {strange[:5]}")
    return model


def predict(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Rows with features and a ``prediction`` column, what ``model`` says of them."""
    layout = _layout(model)
    found = layout and forest.asked(model.stages[-1], layout, df.sparkSession)
    if found and found.most <= forest.MOST_LEAVES:
        return forest.predicted(df, found)
    scored = model.transform(df)
    return scored.select(*df.columns, "prediction")


def _layout(model: PipelineModel):
    """The features of a model with the stages of ``pipeline``; None for another one."""
    *indexers, encoder, assembler, classifier = model.stages if len(model.stages) > 3 else [None] * 3
    kinds = (OneHotEncoderModel, VectorAssembler, RandomForestClassificationModel)
    if not all(map(isinstance, (encoder, assembler, classifier), kinds)):
        return None
    layout = forest.Layout(NUMERIC, categories_of(model))
    plain = pipeline([[""]] * len(CATEGORICAL)).getStages()
    same = (
        [s.getOutputCol() for s in indexers] == encoder.getInputCols() == plain[-3].getInputCols()
        and [*layout.categories] == CATEGORICAL
        and all(s.getHandleInvalid() == "keep" for s in (*indexers, encoder))
        and not encoder.getDropLast()
        and assembler.getInputCols() == plain[-2].getInputCols()
        and classifier.numFeatures == layout.size
        and not classifier.isSet("thresholds")
    )
    return layout if same else None


def ml_filter(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Detections predicted to be real, columns unchanged. A failure is raised."""
    return with_prediction(df, model).where("prediction <> 0").drop("prediction")


def with_prediction(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Detections with ``prediction``, 0 for a false positive."""
    return predict(with_features(df), model).select(*df.columns, "prediction")


def evaluate(predictions: DataFrame, label="Label", prediction="prediction") -> DataFrame:
    """Accuracy, and precision, recall and F1 of class 1, in one aggregation."""
    real, said = F.col(label) == 1, F.col(prediction) == 1

    def count(condition):
        return F.sum(F.when(condition, 1).otherwise(0))

    counts = predictions.agg(
        count(real & said).alias("tp"),
        count(~real & said).alias("fp"),
        count(real & ~said).alias("fn"),
        count(F.col(label) == F.col(prediction)).alias("same"),
        F.count("*").alias("n"),
    )

    def ratio(a, b):
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    scored = counts.select(
        ratio(F.col("same"), F.col("n")).alias("accuracy"),
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
    )
    p, r = F.col("precision"), F.col("recall")
    return scored.withColumn("f1", ratio(2 * p * r, p + r))
