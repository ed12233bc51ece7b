"""Features against the Spark ML transformers whose parameters they use."""

from __future__ import annotations

import math

import pytest
from pyspark.ml.feature import (
    PCA,
    ChiSqSelector,
    OneHotEncoder,
    PolynomialExpansion,
    QuantileDiscretizer,
    StandardScaler,
    StringIndexer,
    VectorAssembler,
    VectorIndexer,
)
from pyspark.sql import functions as F

from tablewright.operators import features

NAMES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def arrays(df, column):
    return [list(row[column]) for row in df.orderBy("id").collect()]


@pytest.fixture(scope="module")
def numbered(spark, items):
    return items.withColumn("id", F.monotonically_increasing_id()).cache()


def by_stage(df, names, stage):
    assembled = VectorAssembler(inputCols=names, outputCol="in").transform(df)
    stage = stage.setInputCol("in").setOutputCol("out")
    made = (stage.fit(assembled) if hasattr(stage, "fit") else stage).transform(assembled)
    return arrays(made.withColumn("out", features.to_array("out")), "out")


def close(ours, theirs):
    assert len(ours) == len(theirs)
    assert all(
        len(a) == len(b) and all(math.isclose(x, y, rel_tol=1e-6, abs_tol=1e-7) for x, y in zip(a, b))
        for a, b in zip(ours, theirs)
    )


@pytest.mark.parametrize("degree", [1, 2, 3])
@pytest.mark.parametrize("names", [NAMES[:1], NAMES[:2], NAMES])
def test_polynomial(numbered, names, degree):
    ours = features.polynomial(numbered, names, "v", degree)
    close(arrays(ours, "v"), by_stage(numbered, names, PolynomialExpansion(degree=degree)))


def test_polynomial_example(spark):
    df = spark.createDataFrame([(0.5, 2.0)], "x double, y double")
    assert features.polynomial(df, ["x", "y"]).head()["x_y_PolynomialExpansion"] == [0.5, 0.25, 2.0, 1.0, 4.0]


@pytest.mark.parametrize("with_mean", [False, True])
def test_standard_scale(numbered, with_mean):
    ours = features.standard_scale(numbered, NAMES, "v", with_mean=with_mean)
    close(arrays(ours, "v"), by_stage(numbered, NAMES, StandardScaler(withMean=with_mean)))


def test_constant_scales_to_zero(spark):
    df = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert [row["x_standardScaler"] for row in features.standard_scale(df, ["x"]).collect()] == [[0.0], [0.0]]


def test_vector_index(numbered, spark):
    names = ["l_linenumber", "l_tax", "l_extendedprice"]
    close(arrays(features.vector_index(numbered, names, "v", 9), "v"), by_stage(numbered, names, VectorIndexer(maxCategories=9)))
    df = spark.createDataFrame([(-1.0,), (0.0,), (2.0,), (3.0,)], "x double")
    found = {row["x"]: row["x_vectorIndexer"][0] for row in features.vector_index(df, ["x"]).collect()}
    assert found == {0.0: 0.0, -1.0: 1.0, 2.0: 2.0, 3.0: 3.0}
    fitted = features.fit_vector_index(df, ["x"])
    with pytest.raises(Exception, match="not among the categories"):
        fitted.transform(spark.createDataFrame([(9.0,)], "x double")).collect()


def test_pca(numbered):
    ours = arrays(features.pca(numbered, NAMES, "v", 2), "v")
    theirs = by_stage(numbered, NAMES, PCA(k=2))
    close([[abs(x) for x in row] for row in ours], [[abs(x) for x in row] for row in theirs])
    assert features.pca(numbered, NAMES).columns[-1] == "降维结果"
    with pytest.raises(ValueError):
        features.pca(numbered, NAMES, k=4)


def test_one_hot(numbered):
    expected = OneHotEncoder(inputCols=["l_linenumber"], outputCols=["out"]).fit(numbered).transform(numbered)
    expected = arrays(expected.withColumn("out", features.to_array("out")), "out")
    both = features.one_hot(numbered, ["l_linenumber", "l_linenumber"], ["独热编码1", "独热编码2"], as_array=True)
    close(arrays(both, "独热编码1"), expected)
    sparse = features.one_hot(numbered, ["l_linenumber"])
    close(arrays(sparse.withColumn("v", features.to_array("l_linenumber_oneHot")), "v"), expected)
    with pytest.raises(ValueError):
        features.one_hot(numbered, ["l_returnflag"])


def test_chi_square(numbered, spark):
    rows = [(i % 3, i % 2, float(i % 3 == 0), i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "a int, b int, c double, y int").withColumn("id", F.monotonically_increasing_id())
    for top in (1, 2):
        assembled = VectorAssembler(inputCols=["a", "b", "c"], outputCol="in").transform(df)
        selector = ChiSqSelector(numTopFeatures=top, featuresCol="in", labelCol="y", outputCol="out")
        expected = selector.fit(assembled).transform(assembled).withColumn("out", features.to_array("out"))
        close(arrays(features.chi_square(df, ["a", "b", "c"], "y", "v", top), "v"), arrays(expected, "out"))
    scores = features.chi_square_scores(df, ["a", "b", "c"], "y").collect()
    assert scores[0]["column"] == "a" and scores[0]["p_value"] < 1e-9
    with pytest.raises(ValueError):
        features.chi_square(df, ["a"], "y")


def test_quantile_bins(numbered):
    for buckets in (2, 5, 10):
        expected = QuantileDiscretizer(numBuckets=buckets, inputCol="l_extendedprice", outputCol="out", relativeError=0.0)
        expected = expected.fit(numbered).transform(numbered).orderBy("id").collect()
        ours = features.quantile_bins(numbered, "l_extendedprice", "v", buckets, relative_error=0.0).orderBy("id").collect()
        assert [r["v"] for r in ours] == [r["out"] for r in expected]
    named = features.quantile_bins(numbered, "l_quantity")
    assert named.columns[-1] == "l_quantity(分位数离散化)"
    assert named.select(named.columns[-1]).distinct().count() == 5


def test_quantile_bins_of_constant_and_null_columns(spark):
    df = spark.createDataFrame([(1.0, None), (1.0, None)], "a double, b double")
    assert {r["v"] for r in features.quantile_bins(df, "a", "v", 4, relative_error=0.0).collect()} == {1.0}
    assert {r["v"] for r in features.quantile_bins(df, "b", "v", 4, relative_error=0.0).collect()} == {None}
    with pytest.raises(ValueError):
        features.quantile_bins(spark.createDataFrame([("x",)], "t string"), "t")


@pytest.mark.parametrize("limit", [100_000, 3])
def test_string_index(numbered, limit):
    expected = StringIndexer(inputCol="l_linenumber", outputCol="out").fit(numbered).transform(numbered)
    expected = [r["out"] for r in expected.orderBy("id").collect()]
    ours = features.string_index(numbered, "l_linenumber", "v", label_limit=limit).orderBy("id").collect()
    assert [r["v"] for r in ours] == expected


@pytest.mark.parametrize("limit", [100, 1])
def test_string_index_ties_and_missing(spark, limit):
    df = spark.createDataFrame([(v,) for v in ["b", "a", "c", "c", None, "é", "z"]], "v string")
    index = lambda how: {r["v"]: r["i"] for r in features.string_index(df, "v", "i", handle_invalid=how, label_limit=limit).collect()}
    known = {"c": 0.0, "a": 1.0, "b": 2.0, "z": 3.0, "é": 4.0}
    assert index("skip") == known
    assert index("keep") == {**known, None: 5.0}
    with pytest.raises(Exception):
        index("error")


def test_string_index_with_hot_labels(spark):
    """A third of the rows share one label and a tenth have none; the rest are all different."""
    value = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 10 != 1, F.concat(F.lit("v"), "id"))
    df = spark.range(0, 30_000, 1, 8).select("id", value.alias("v"))
    found = features.string_index(df, "v", "i", handle_invalid="keep", label_limit=10)
    assert found.count() == 30_000
    assert found.where("v = 'hot'").select("i").distinct().collect()[0]["i"] == 0.0
    labels = df.select("v").distinct().where("v is not null").count()
    assert found.select("i").distinct().count() == labels + 1
    assert found.where("v is null").select("i").distinct().collect()[0]["i"] == float(labels)


@pytest.mark.parametrize("how, sizes", [("skip", 1), ("keep", 3)])
def test_missing_inputs(gaps, how, sizes):
    assert features.assemble_array(gaps, ["i", "d"], "v", how).count() == sizes
    assert features.polynomial(gaps, ["i", "d"], "v", handle_invalid=how).count() == sizes


def test_missing_inputs_are_errors_by_default(gaps):
    with pytest.raises(Exception, match="holds a null or NaN"):
        features.assemble_array(gaps, ["i", "d"], "v").collect()
    with pytest.raises(ValueError):
        features.assemble_array(gaps, ["s"], "v")


def test_fitted_features_apply_to_other_tables(numbered):
    train, test = numbered.where("id % 2 = 0"), numbered.where("id % 2 = 1")
    fitted = features.fit_standard_scale(train, ["l_quantity"], "v")
    factor = 1 / train.agg(F.stddev_samp("l_quantity")).head()[0]
    row = fitted.transform(test).head()
    assert math.isclose(row["v"][0], row["l_quantity"] * factor, rel_tol=1e-6)
    assert features.fit_string_index(train, "l_returnflag").transform(test).columns[-1] == "l_returnflag_string_indexer"
    many = features.fit_string_index(train, "l_returnflag", label_limit=2)
    few = features.fit_string_index(train, "l_returnflag")
    assert many.transform(test).exceptAll(few.transform(test)).count() == 0
