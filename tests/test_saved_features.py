"""Features that are fitted once, saved, loaded and applied elsewhere; wide tests and statistics."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from conftest import plan_of
from pyspark.ml.stat import ChiSquareTest
from pyspark.sql import functions as F

from tablewright.functions.moments import chi_square_tail
from tablewright.operators import explore, features, rows, scoring, training
from tablewright.plans.flow import build

FITS = {
    "scale": lambda df: features.fit_standard_scale(df, ["l_quantity", "l_tax", "pair"], "v", with_mean=True),
    "pca": lambda df: features.fit_pca(df, ["l_quantity", "l_tax", "l_discount"], "v", 2),
    "vector_index": lambda df: features.fit_vector_index(df, ["l_linenumber", "l_tax"], "v", 20),
    "polynomial": lambda df: features.fit_polynomial(df, ["l_tax", "l_discount"], "v", 3),
    "one_hot": lambda df: features.fit_one_hot(df, ["l_linenumber"], ["v"], as_array=True),
    "one_hot_sparse": lambda df: features.fit_one_hot(df, ["l_linenumber"], ["v"]),
    "chi_square": lambda df: features.fit_chi_square(df, ["l_linenumber", "l_quantity", "l_tax"], "flag", "v", 2),
    "bins": lambda df: features.fit_quantile_bins(df, "l_quantity", "v", 4, relative_error=0.0),
    "few_labels": lambda df: features.fit_string_index(df, "l_returnflag", "v"),
    "many_labels": lambda df: features.fit_string_index(df, "l_partkey", "v", label_limit=5),
}


@pytest.fixture(scope="module")
def points(items):
    flag = F.when(F.col("l_returnflag") == "A", 0).otherwise(1)
    return items.select("*", flag.alias("flag"), F.array("l_tax", "l_discount").alias("pair"))


@pytest.mark.parametrize("name", FITS)
def test_saved_features_give_the_same_columns(spark, points, tmp_path, name):
    fitted = FITS[name](points)
    path = fitted.save(str(tmp_path / "feature"))
    other = spark.newSession()
    loaded = features.load_feature(other, path)
    again = other.createDataFrame(points.collect(), points.schema)
    show = lambda df: sorted(str(r) for r in df.select("l_orderkey", "l_linenumber", "l_partkey", "v").collect())
    assert show(loaded.transform(again)) == show(fitted.transform(points))
    with pytest.raises(Exception):
        fitted.save(path, overwrite=False)


def test_fitted_features_keep_their_rules(spark, points, tmp_path):
    fitted = features.fit_standard_scale(points.where("l_tax > 0"), ["l_tax"], "v", handle_invalid="skip")
    loaded = features.load_feature(spark, fitted.save(str(tmp_path / "f")))
    gaps = spark.createDataFrame([(1.0,), (None,), (float("nan"),)], "l_tax double")
    assert loaded.transform(gaps).count() == fitted.transform(gaps).count() == 1


def test_string_index_of_many_labels(spark, tmp_path):
    """200,000 labels: fitted, saved, loaded and applied; nothing raises and nothing is gathered."""
    df = spark.range(0, 300_000, 1, 8).select("id", F.when(F.col("id") < 200_000, F.concat(F.lit("v"), "id")).otherwise("hot").alias("v"))
    fitted = features.fit_string_index(df, "v", "i")
    assert isinstance(fitted, features.FittedStringIndex) and fitted.size == 200_001
    loaded = features.load_feature(spark, fitted.save(str(tmp_path / "labels")))
    out = loaded.transform(df)
    assert out.agg(F.countDistinct("i"), F.max("i"), F.min(F.when(F.col("v") == "hot", F.col("i")))).head()[:] == (200_001, 200_000.0, 0.0)
    unknown = spark.createDataFrame([("v7",), ("new",), (None,)], "v string")
    with pytest.raises(Exception, match="unknown when fitting"):
        loaded.transform(unknown).collect()


def test_chi_square_tail_against_closed_forms():
    for degrees, x in itertools.product((2, 4, 10, 98), (0.01, 1.0, 9.7, 55.0, 180.0)):
        series = sum(math.exp(k * math.log(x / 2) - math.lgamma(k + 1) - x / 2) for k in range(degrees // 2))
        assert math.isclose(chi_square_tail(x, degrees), series, rel_tol=1e-9, abs_tol=1e-300)
    assert math.isclose(chi_square_tail(3.2, 1), math.erfc(math.sqrt(1.6)), rel_tol=1e-12)
    assert chi_square_tail(0.0, 7) == 1.0 and abs(chi_square_tail(1e5, 100_000) - 0.5) < 0.01


def test_chi_square_of_many_values(spark):
    df = spark.range(0, 100_000, 1, 8).select((F.col("id") % 50_000).cast("double").alias("a"), (F.col("id") % 3).alias("b"), (F.col("id") % 2).alias("y"))
    a, b = features.chi_square_scores(df, ["a", "b"], "y").collect()
    assert (a["degrees_of_freedom"], b["degrees_of_freedom"]) == (49_999, 2)
    assert math.isclose(a["statistic"], 100_000, rel_tol=1e-9) and a["p_value"] < 1e-12 and b["p_value"] > 0.99
    kept = features.chi_square(df, ["b", "a"], "y", "v", 1)
    assert kept.where(F.get("v", F.lit(0)) != F.col("a")).count() == 0


def test_chi_square_equals_the_driver_side_test(points):
    names = ["l_linenumber", "l_quantity", "l_tax"]
    vectors = features.assemble(points, names, "features").select("features", F.col("flag").cast("double").alias("label"))
    expected = ChiSquareTest.test(vectors, "features", "label", flatten=True).orderBy("featureIndex").collect()
    for ours, theirs in zip(features.chi_square_scores(points, names, "flag").collect(), expected):
        assert ours["degrees_of_freedom"] == theirs["degreesOfFreedom"]
        assert math.isclose(ours["statistic"], theirs["statistic"], rel_tol=1e-9) and math.isclose(ours["p_value"], theirs["pValue"], rel_tol=1e-6)


def _curves(labels, scores):
    order = sorted(set(scores), reverse=True)
    pos, neg = sum(labels), len(labels) - sum(labels)
    tp = fp = 0
    roc = pr = 0.0
    last = None
    for s in order:
        up = sum(y for y, x in zip(labels, scores) if x == s)
        down = sum(x == s for x in scores) - up
        before = tp / (tp + fp) if tp + fp else None
        roc += down / neg * (tp + up / 2) / pos if neg and pos else 0
        tp, fp = tp + up, fp + down
        precise = tp / (tp + fp)
        pr += up / pos * (precise + (precise if before is None else before)) / 2 if pos else 0
    return pr, roc


@pytest.mark.parametrize("digits", [0, 2, 9])
def test_curves_in_one_pass(spark, digits):
    draw = np.random.default_rng(digits)
    scores = [round(float(x), digits) for x in draw.normal(size=3_000)]
    labels = [int(x) for x in draw.random(3_000) < 1 / (1 + np.exp(-np.array(scores)))]
    df = spark.createDataFrame([(float(y), 1.0, s) for y, s in zip(labels, scores)], "y double, p double, s double").repartition(6)
    found = {r[0]: r[1] for r in scoring.binary_metrics(df, "y", "p", "s").collect()}
    pr, roc = _curves(labels, scores)
    assert math.isclose(found["Area under PR"], pr, rel_tol=1e-9) and math.isclose(found["Area under ROC"], roc, rel_tol=1e-9)
    assert found["正确个数"] == sum(labels)


def test_curves_edges(spark):
    value = lambda data: [r[1] for r in scoring.binary_metrics(spark.createDataFrame(data, "y double, p double, s double"), "y", "p", "s").collect()]
    assert value([(1.0, 1.0, 0.3), (None, 1.0, 0.2), (0.0, 0.0, None), (0.0, 0.0, 0.1)]) == [2.0, 1.0, 1.0, 1.0]
    assert value([]) [:2] == [0.0, None]
    assert value([(1.0, 1.0, 0.3)])[3] == 1.0


def test_wide_correlation(spark):
    """100 columns with gaps: rows are not multiplied, results equal numpy's."""
    draw = np.random.default_rng(1)
    data = draw.normal(size=(300, 100)).cumsum(axis=1) + 1e6
    data[draw.random(data.shape) < 0.1] = np.nan
    names = [f"c{i}" for i in range(100)]
    df = spark.createDataFrame([tuple(map(float, row)) for row in data], ", ".join(f"{n} double" for n in names)).repartition(4)
    report = explore.correlation(df, names)
    assert "Generate" not in plan_of(explore._correlations(df, names)[1])
    found = {(r[0], r[1]): r[2] for r in report.collect()}
    assert len(found) == 10_000
    for i, j in ((0, 1), (3, 97), (50, 51), (99, 0), (42, 42)):
        both = ~np.isnan(data[:, i]) & ~np.isnan(data[:, j])
        assert math.isclose(found[f"c{i}", f"c{j}"], np.corrcoef(data[both, i], data[both, j])[0, 1], rel_tol=1e-8)


def test_correlation_edges(spark):
    empty = spark.createDataFrame([], "a double, b double")
    assert [r[2] for r in explore.correlation(empty, ["a", "b"]).collect()] == [None] * 4
    part = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (7.0, None), (None, 1.0)], "a double, b double")
    assert [r[2] for r in explore.correlation(part, ["a", "b"]).collect()] == [1.0, None, None, 1.0]


def test_wide_statistics_are_not_multiplied(spark):
    names = [f"c{i}" for i in range(60)]
    df = spark.range(200).select(*[(F.col("id") * (i + 1) % 17).cast("double").alias(n) for i, n in enumerate(names)])
    found = {r["column"]: r for r in explore.describe(df, names).collect()}
    assert len(found) == 60
    for i in (0, 23, 24, 59):
        values = np.array([r * (i + 1) % 17 for r in range(200)], dtype=float)
        assert math.isclose(found[f"c{i}"]["mean"], values.mean()) and math.isclose(found[f"c{i}"]["variance"], values.var(ddof=1))
        assert found[f"c{i}"]["median"] == np.median(values)


def test_descent_compiles_once(spark, items):
    """The weights are data: later iterations find the code of the first."""
    metric = spark._jvm.org.apache.spark.metrics.source.CodegenMetrics.METRIC_COMPILATION_TIME()
    df = items.select((F.col("l_quantity") > 25).cast("int").alias("y"), (F.col("l_quantity") - 25.5).alias("x"), "l_tax")
    training.train_svm(df, "y", ["x", "l_tax"], iterations=2, convergence_tol=0.0)
    before = metric.getCount()
    model = training.train_svm(df, "y", ["x", "l_tax"], iterations=12, convergence_tol=0.0).model
    assert metric.getCount() - before <= 6 and model.weights[0] > 0


def test_scatter_sample_is_the_same_on_any_layout(items):
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    draw = lambda df: sorted(map(tuple, rows.scatter_sample(df, ["l_quantity", "l_tax"], 30, seed=5, key=key).collect()))
    first = draw(items)
    assert len(first) == 30 and draw(items.repartition(13)) == first == draw(items.coalesce(1))
    assert draw(items.where("l_orderkey % 2 = 0").unionByName(items.where("l_orderkey % 2 = 1"))) == first
    other = sorted(map(tuple, rows.scatter_sample(items, ["l_quantity", "l_tax"], 30, seed=6, key=key).collect()))
    assert other != first and rows.scatter_sample(items, ["l_quantity", "l_tax"]).count() == 50


def test_model_report_of_other_tables(spark, items):
    df = items.select("l_quantity", "l_linenumber", (F.col("l_quantity") > 25).cast("int").alias("y"), F.when(F.col("l_linenumber") > 3, "late").otherwise("early").alias("half"))
    lr = training.train_lr(df.where("l_linenumber < 5"), "y", ["l_quantity"], iterations=10)
    report = {(r[0], r[1]): r[2] for r in scoring.model_report(lr, df.where("l_linenumber >= 5"), "y").collect()}
    assert report["parameter", "maxIter"] == "10" and report["model", "feature[0]"] == "l_quantity" and float(report["metric", "精准度"]) > 0.95
    forest = training.train_forest(df, "half", ["l_linenumber"], num_trees=3, seed=1)
    report = {(r[0], r[1]): r[2] for r in scoring.model_report(forest, df, "half").collect()}
    assert report["metric", "accuracy"] == "1.0" and report["model", "class[0]"] in ("late", "early")
    svm = training.train_svm(df.withColumn("l_quantity", F.col("l_quantity") - 25.5), "y", ["l_quantity"], iterations=5)
    assert ("parameter", "threshold") in {(r[0], r[1]) for r in training.model_settings(svm).collect()}


def test_shared_tables_of_a_flow_are_released(spark, items):
    def node(name, parent, parameter):
        return {"name": name, "config": {"parameter": parameter, "fileUrl": [{parent: 0}]}}

    spec = {
        "data": {"name": 5001, "config": {}},
        "kept": node(1001, "data", {"parameter": [{"colName": "l_quantity", "operate": ">", "value": "10", "relation": ""}]}),
        "a": node(3002, "kept", {"columnName": "l_returnflag"}),
        "b": node(3002, "kept", {"columnName": "l_linenumber"}),
        "c": node(3002, "data", {"columnName": "l_linestatus"}),
    }
    table = items.select("*")
    outputs = build(spec, {"data": table}, persist_shared=True)
    assert outputs.kept() == ["data", "kept"] and outputs["kept"].is_cached
    assert outputs["a"].count() == 3
    outputs.release("a")
    assert outputs["kept"].is_cached
    outputs.release("b")
    assert not outputs["kept"].is_cached and outputs["data"].is_cached and outputs.kept() == ["data"]
    outputs.close()
    assert not table.is_cached and outputs.kept() == []
    with build(spec, {"data": items.select("*")}, persist_shared=True) as outputs:
        assert outputs["b"].count() == 7
    assert not outputs["data"].is_cached
