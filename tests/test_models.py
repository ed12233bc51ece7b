"""Training, scoring, saving and measuring classifiers."""

from __future__ import annotations

import math
import re

import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import StringIndexer
from pyspark.mllib.classification import SVMWithSGD
from pyspark.mllib.evaluation import BinaryClassificationMetrics
from pyspark.mllib.regression import LabeledPoint
from pyspark.sql import functions as F

from tablewright.operators import scoring, training
from tablewright.plans.queries import QUERIES

FEATURES = ["l_quantity", "l_discount", "l_tax"]


@pytest.fixture(scope="module")
def labelled(spark, items):
    kept = items.withColumn("label01", (F.col("l_returnflag") == "R").cast("int"))
    kept = kept.withColumn("centred", F.col("l_quantity") - 25).withColumn("three", F.col("l_linenumber") % 3)
    big = (F.col("l_quantity") > 30).cast("int")
    return kept.withColumn("noisy", F.when(F.col("l_partkey") % 5 == 0, 1 - big).otherwise(big)).cache()


def report(df):
    return {row["指标"]: row["值"] for row in df.collect()}


@pytest.mark.parametrize("reg_type", ["l2", "l1", None])
def test_svm_equals_stochastic_descent_over_all_rows(labelled, reg_type):
    names = ["centred", "l_discount"]
    ours = training.train_svm(labelled, "noisy", names, iterations=6, step=0.5, reg_param=0.05, reg_type=reg_type)
    points = labelled.select("noisy", *names).rdd.map(lambda r: LabeledPoint(r[0], [r[1], r[2]]))
    theirs = SVMWithSGD.train(points, iterations=6, step=0.5, regParam=0.05, regType=reg_type, convergenceTol=0.001)
    assert ours.model.weights == pytest.approx(list(theirs.weights), rel=1e-9, abs=1e-12)


def test_svm_keeps_the_best_weights_after_a_step_that_turns_the_margin_round(spark):
    """Clear rows and three far wrong ones: the fourth and the eighth step overshoot, most rows would be wrong."""
    clear = [(float(x), int(x > 0)) for x in range(-12, 13) if x]
    rows = spark.createDataFrame(clear + [(20.0, 0), (22.0, 0), (24.0, 0)], "x double, y int")

    def weight(last: int, keep: str) -> float:
        return training.train_svm(rows, "y", ["x"], iterations=last, convergence_tol=0.0, keep=keep).model.weights[0]

    assert weight(4, "last") < 0 < weight(4, "best") == pytest.approx(weight(3, "last"))
    assert weight(8, "last") < 0 < weight(8, "best")
    with pytest.raises(ValueError):
        weight(2, "first")


def test_perceptron_keeps_no_second_copy_of_its_rows(labelled, monkeypatch):
    """Spark's trainer keeps the stacked rows; the points held beside them took as much memory again."""
    def no_copy(*_):
        raise AssertionError("the rows are held beside the trainer's stacks")

    monkeypatch.setattr(training, "held", no_copy)
    model = training.train_mlp(labelled, "label01", ["centred", "l_tax"], layers=[2, 3, 2], iterations=3, seed=1)
    assert scoring.predict(model, labelled, label="label01").count() == labelled.count()


def test_inspection_takes_the_accuracy_in_an_aggregate(labelled, monkeypatch):
    """F8: the summary's own accuracy is a pass that turns rows and probabilities into objects."""
    trained = training.train_lr(labelled, "noisy", ["centred"], iterations=5)
    wanted = trained.model.summary.accuracy

    def no_pass(_):
        raise AssertionError("the summary's pass was taken")

    monkeypatch.setattr(type(trained.model.summary), "accuracy", property(no_pass))
    assert {r["term"]: r["value"] for r in training.inspect_model(trained).collect()}["accuracy"] == wanted


def test_svm_checks_its_input(labelled, spark):
    with pytest.raises(ValueError):
        training.train_svm(labelled, "three", FEATURES, iterations=2)
    with pytest.raises(ValueError):
        training.train_svm(labelled, "label01", FEATURES, engine="owlqn", reg_type="l1")
    with pytest.raises(ValueError):
        training.train_svm(labelled, "label01", FEATURES, engine="other")


@pytest.fixture(scope="module")
def svm(labelled):
    return training.train_svm(labelled, "noisy", ["centred", "l_tax"], iterations=5)


def test_svm_prediction_columns(labelled, svm):
    assert scoring.predict(svm, labelled).columns == ["prediction_result"]
    assert scoring.predict(svm, labelled, label="").columns == ["prediction_result"]
    shown = scoring.predict(svm, labelled, label="noisy")
    assert shown.columns == ["prediction_result", "noisy"] and shown.count() == labelled.count()
    with pytest.raises(ValueError):
        scoring.predict(svm, labelled, features=["l_tax"])


def test_svm_missing_features(spark, svm):
    df = spark.createDataFrame([(1.0, 0.1), (None, 0.2)], "centred double, l_tax double")
    assert scoring.predict(svm, df, handle_invalid="skip").count() == 1
    with pytest.raises(Exception, match="null"):
        scoring.predict(svm, df).collect()


def test_svm_metrics_use_margins(labelled, svm):
    found = report(scoring.evaluate(svm, labelled, "noisy"))
    w = svm.model.weights
    margin = F.col("centred") * w[0] + F.col("l_tax") * w[1]
    rows = labelled.select(margin.alias("m"), "noisy").collect()
    correct = sum((r["m"] > 0) == (r["noisy"] == 1) for r in rows)
    assert found["正确个数"] == correct and math.isclose(found["精准度"], correct / len(rows))
    scored = labelled.select(margin, F.col("noisy").cast("double")).rdd.map(lambda r: (r[0], r[1]))
    metrics = BinaryClassificationMetrics(scored)
    assert found["Area under ROC"] == pytest.approx(metrics.areaUnderROC, abs=1e-9)
    assert found["Area under PR"] == pytest.approx(metrics.areaUnderPR, abs=1e-9)


@pytest.mark.parametrize("prediction", ["mixed", "all one", "all zero", "perfect"])
def test_hard_metrics_equal_the_evaluator(labelled, prediction):
    guess = {
        "mixed": (F.col("l_quantity") > 25).cast("double"),
        "all one": F.lit(1.0),
        "all zero": F.lit(0.0),
        "perfect": F.col("noisy").cast("double"),
    }[prediction]
    df = labelled.select(F.col("noisy").alias("y"), guess.alias("p"))
    found = report(scoring.binary_metrics(df, "y", "p"))
    curve = BinaryClassificationEvaluator(rawPredictionCol="p", labelCol="y", numBins=0)
    assert found["Area under PR"] == pytest.approx(curve.setMetricName("areaUnderPR").evaluate(df), abs=1e-12)
    assert found["Area under ROC"] == pytest.approx(curve.setMetricName("areaUnderROC").evaluate(df), abs=1e-12)
    assert report(scoring.binary_metrics(df, "y", "p", "p")) == pytest.approx(found, abs=1e-9)


def test_lr_metrics_use_predictions_unless_asked(labelled):
    trained = training.train_lr(labelled, "noisy", FEATURES, iterations="5", fit_intercept="True", threshold="0.5")
    hard, raw = report(scoring.evaluate(trained, labelled, "noisy")), report(scoring.evaluate(trained, labelled, "noisy", score="raw"))
    assert hard["精准度"] == raw["精准度"] and hard["Area under ROC"] != raw["Area under ROC"]
    assert raw["Area under ROC"] == pytest.approx(trained.model.summary.areaUnderROC, abs=1e-4)  # binned
    terms = {r["term"] for r in training.inspect_model(trained).collect()}
    assert {*FEATURES, "intercept", "area_under_roc"} <= terms


def test_multiclass_metrics_equal_the_evaluator(labelled):
    df = labelled.select(F.col("three").cast("double").alias("y"), (F.col("l_linenumber") % 2).cast("double").alias("p"))
    found = report(scoring.multiclass_metrics(df, "y", "p"))
    for name, metric in (("accuracy", "accuracy"), ("weighted_precision", "weightedPrecision")):
        evaluator = MulticlassClassificationEvaluator(predictionCol="p", labelCol="y", metricName=metric)
        assert found[name] == pytest.approx(evaluator.evaluate(df), abs=1e-12)


def trainers(labelled):
    yield "gbt", training.train_gbt(labelled, "l_linestatus", ["l_quantity", "l_tax"], iterations=2, max_depth=2, seed=1), "l_linestatus"
    yield "forest", training.train_forest(labelled, "l_returnflag", FEATURES, num_trees=3, max_depth=3, seed=1), "l_returnflag"
    yield "lr", training.train_lr(labelled, "noisy", FEATURES, iterations=3), "noisy"
    yield "lr_multi", training.train_lr_multi(labelled, "three", FEATURES, iterations=3), "three"
    yield "mlp", training.train_mlp(labelled, "three", FEATURES, layers=["3", "4", "3"], iterations=3, seed=1), "three"
    yield "svm", training.train_svm(labelled, "noisy", FEATURES, iterations=2), "noisy"
    yield "svm", training.train_svm(labelled, "noisy", FEATURES, iterations=2, engine="owlqn"), "noisy"


def test_save_load_and_predict(spark, labelled, tmp_path):
    for i, (kind, trained, label) in enumerate(trainers(labelled)):
        path = str(tmp_path / f"m{i}")
        loaded = training.load_model(spark, trained.save(path))
        assert (loaded.kind, loaded.features, loaded.label, loaded.classes) == (kind, trained.features, label, trained.classes)
        a, b = scoring.predict(trained, labelled, label=label), scoring.predict(loaded, labelled, label=label)
        assert a.columns == b.columns and a.exceptAll(b).count() == 0
        if kind != "svm":
            classes = ["predicted_label"] if trained.classes else []
            assert a.columns == ["prediction", *classes, "label", "features"]
            assert scoring.predict(loaded, labelled).columns == ["prediction", *classes, "features"]
        assert training.inspect_model(loaded).count() > 0
        if kind in ("gbt", "forest"):
            assert sum(r["importance"] for r in training.feature_importances(loaded).collect()) == pytest.approx(1.0)
            assert "If (feature" in training.tree_text(loaded)
            assert set(trained.classes) == {r[0] for r in labelled.select(label).distinct().collect()}
        else:
            with pytest.raises(ValueError):
                training.feature_importances(loaded)


@pytest.fixture
def trained_on(monkeypatch):
    """How many rows Spark's trainer of boosted trees was given, call by call."""
    seen: list[int] = []

    class Counting(GBTClassifier):
        def fit(self, dataset, params=None):
            seen.append(dataset.count())
            return super().fit(dataset, params)

    monkeypatch.setattr(training, "GBTClassifier", Counting)
    return seen


@pytest.fixture(scope="module")
def scattered(labelled):
    """Few and many different values, many zeros, one value; a label that follows them loosely."""
    wide = labelled.withColumn("g", F.randn(3) * 100).withColumn("rare", (F.rand(5) > 0.9).cast("int"))
    wide = wide.withColumn("zeros", F.when(F.rand(6) < 0.3, 0.0).otherwise(F.randn(8))).withColumn("one", F.lit(3))
    near = F.col("g") + F.col("l_quantity") * 2 + F.rand(11) * 60 > 80
    return wide.withColumn("y", F.when(near != (F.col("rare") == 1), "yes").otherwise("no")).cache()


def tree_lines(trained) -> tuple[list[str], list[float]]:
    text = re.sub(r"uid ?= ?\S+", "", training.tree_text(trained))
    return re.sub(r"Predict: \S+", "", text).splitlines(), [float(x) for x in re.findall(r"Predict: (\S+)", text)]


@pytest.mark.parametrize(
    "names, settings",
    [
        (["l_quantity", "l_tax"], {}),
        (["g", "one"], {}),
        (["zeros", "rare"], {"step": 0.3}),
        (["l_quantity", "rare"], {"min_instances_per_node": 25}),
    ],
)
def test_groups_of_equal_bins_give_the_trees_of_all_rows(scattered, trained_on, monkeypatch, tmp_path, names, settings):
    """the trainer went over all rows for every level of every tree, though it sees of them only bins and class."""
    def train():
        return training.train_gbt(scattered, "y", names, iterations=4, max_depth=4, seed=1, **settings)

    plain = train()
    monkeypatch.setattr(training, "GROUPED_FROM", 0)
    grouped = train()
    assert trained_on[0] == scattered.count() and trained_on[1] <= 32 * 32 * 2
    (shape, leaves), (same, others) = tree_lines(plain), tree_lines(grouped)
    assert same == shape and others == pytest.approx(leaves, rel=1e-9, abs=1e-12)
    wanted, found = (training.model_settings(m).collect() for m in (plain, grouped))
    assert found == wanted
    plain.model.save(str(tmp_path / "plain"))
    grouped.model.save(str(tmp_path / "grouped"))
    counts = [
        [r[0] for r in scattered.sparkSession.read.parquet(str(tmp_path / k / "data")).orderBy("treeID", "nodeData.id").select("nodeData.rawCount").collect()]
        for k in ("plain", "grouped")
    ]
    assert counts[0] == counts[1]
    a, b = scoring.predict(plain, scattered, label="y"), scoring.predict(grouped, scattered, label="y")
    assert a.exceptAll(b).count() == 0 and a.count() == b.count()


def test_rows_that_cannot_be_grouped_are_trained_on_as_they_are(scattered, trained_on, monkeypatch):
    """Too many combinations of bins, kinds instead of numbers, and more rows asked of a node than half the table has."""
    monkeypatch.setattr(training, "GROUPED_FROM", 0)
    kinds = StringIndexer(inputCol="l_returnflag", outputCol="kind").fit(scattered).transform(scattered)
    training.train_gbt(scattered, "y", ["g", "zeros", "l_quantity"], iterations=1, max_depth=1)
    training.train_gbt(scattered, "y", ["rare"], iterations=1, max_depth=1, min_instances_per_node=5_000)
    training.train_gbt(kinds, "y", ["kind"], iterations=1, max_depth=1)
    monkeypatch.setattr(training, "has_scratch", lambda _: False)
    training.train_gbt(scattered, "y", ["rare"], iterations=1, max_depth=1)
    assert trained_on == [scattered.count()] * 4


@pytest.mark.parametrize("value, message", [(None, "assembling"), (math.nan, "assembling"), (math.inf, "Vector values MUST NOT be NaN or Infinity")])
def test_groups_refuse_what_the_trainer_refuses(scattered, monkeypatch, value, message):
    bad = scattered.withColumn("rare", F.when(F.col("l_orderkey") % 1000 != 3, F.col("rare")).otherwise(F.lit(value).cast("double")))
    for least in (10**9, 0):
        monkeypatch.setattr(training, "GROUPED_FROM", least)
        with pytest.raises(Exception, match=message):
            training.train_gbt(bad, "y", ["rare", "l_quantity"], iterations=1, max_depth=1)


@pytest.mark.parametrize("name", ["feature_importance", "gbt_binary"])
def test_boosted_queries_pass_over_groups_of_a_large_table(spark, tmp_path, trained_on, name):
    """all rows of the table were the trainer's; no value of discount and tax comes twice here."""
    rows = 130_000
    key = F.col("id").cast("double")
    made = spark.range(rows).select(
        (F.col("id") % 50 + 1).cast("double").alias("l_quantity"), (F.col("id") % 2_000).alias("l_partkey"),
        (F.col("id") % 7 + 1).cast("int").alias("l_linenumber"), (F.rand(1) + key).alias("l_discount"), (F.rand(2) - key).alias("l_tax"),
    )
    made.write.parquet(str(tmp_path / "lineitem.parquet"))
    found = QUERIES[name](spark, str(tmp_path))
    if name == "gbt_binary":
        assert found.count() == rows and found.where("label != predicted_label").count() == 0
    else:
        assert {r["feature"]: r["importance"] for r in found.collect()} == {"l_linenumber": 1.0, "l_discount": 0.0}
    assert trained_on[0] <= 7 * 32 * (32 if name == "gbt_binary" else 1)


def test_lenient_features(spark, gaps):
    found = training.lenient_features(gaps, ["i", "s"], "d")
    assert [tuple(r)[:2] for r in found.collect()] == [(1.0, 0.0), (2.0, 0.0), (0.0, 0.0)]
    text = spark.createDataFrame([(" 3 ", "1"), ("x", "0"), ("4", "y")], "a string, y string")
    trained = training.train_lr_multi(text, "y", ["a"], iterations=1, lenient=True)
    assert trained.features == ["a"]


def test_boolean_labels_are_classes(labelled):
    df = labelled.withColumn("yes", F.col("noisy") == 1)
    trained = training.train_gbt(df, "yes", FEATURES, iterations=1, max_depth=2, seed=1)
    assert sorted(trained.classes) == ["false", "true"]


def test_bad_training_parameters(labelled):
    with pytest.raises(ValueError):
        training.train_mlp(labelled, "three", FEATURES, layers=[4, 3])
    with pytest.raises(ValueError):
        training.train_gbt(labelled, "three", FEATURES, iterations=1)
