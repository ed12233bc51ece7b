"""Wide tables, feature columns as inputs, hot labels."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tablewright.operators import features, training
from tablewright.operators.scoring import predict
from tablewright.plans.flow import build


def test_svm_with_many_features(spark):
    wide = spark.range(60).select((F.col("id") % 2).cast("double").alias("y"), *[((F.col("id") * (i + 3)) % 7 + F.col("id") % 2).cast("double").alias(f"f{i}") for i in range(500)])
    model = training.train_svm(wide, "y", [f"f{i}" for i in range(500)], iterations=2)
    assert len(model.model.weights) == 500
    assert predict(model, wide).count() == 60


def test_vector_index_with_many_categories(spark):
    df = spark.range(1500).select(F.col("id").cast("double").alias("x"))
    out = features.vector_index(df, ["x"], "v", max_categories=2000)
    assert sorted(r["v"][0] for r in out.collect()) == [float(i) for i in range(1500)]


def test_scaled_arrays_train_and_predict(spark, items):
    rows = items.withColumn("y", (F.col("l_quantity") > 25).cast("int"))
    scaled = features.standard_scale(rows, ["l_quantity", "l_tax"], "scaled")
    for train in (training.train_svm, training.train_lr):
        model = train(scaled, "y", ["scaled", "l_discount"], iterations=5)
        assert predict(model, scaled).count() == items.count()
    again = features.pca(scaled, ["scaled", "l_discount"], k=2)
    assert again.count() == items.count()


def test_other_types_are_no_features(spark):
    df = spark.createDataFrame([(1, {"a": 1.0})], "y int, m map<string,double>")
    for lenient in (False, True):
        with pytest.raises(ValueError):
            training.input_columns(df, ["m"], lenient=lenient)
    arrays = spark.createDataFrame([(1, [1.0, 2.0]), (0, [3.0, 4.0])], "y int, a array<double>")
    got = arrays.select(*training.input_columns(arrays, ["a"], lenient=True)).collect()
    assert sorted(map(tuple, got)) == [(1.0, 2.0), (3.0, 4.0)]


def test_one_hot_arrays_have_a_limit(spark):
    df = spark.createDataFrame([(1,), (3,), (20_000,)], "k int")
    with pytest.raises(ValueError):
        features.one_hot(df, ["k"], ["o"], as_array=True)
    small = features.one_hot(df.where("k < 10"), ["k"], ["o"], as_array=True, drop_last=False)
    assert sorted(tuple(r["o"]) for r in small.collect()) == [(0.0, 0.0, 0.0, 1.0), (0.0, 1.0, 0.0, 0.0)]


def test_labels_are_counted_before_they_are_gathered(spark):
    df = spark.range(1200).select(F.col("id").cast("double").alias("y"), F.col("id").cast("double").alias("x"))
    for train in (training.train_gbt, training.train_forest):
        with pytest.raises(ValueError, match="classes"):
            train(df, "y", ["x"])


def test_hot_labels_and_nulls_are_not_shuffled(spark):
    """A label and nulls that fill the table, with neither broadcast by size nor adaptive plans to help."""
    rows = spark.range(40_000).select(F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, F.lit("hot")).otherwise(F.concat(F.lit("v"), F.col("id"))).alias("s"))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        out = features.string_index(rows, "s", "i", handle_invalid="keep", label_limit=10)
        sizes = sorted(r["n"] for r in out.where("s like 'v%'").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect())
        assert out.count() == 40_000 and out.where("s = 'hot' and i = 0").count() == 13_333
        assert sizes[-1] <= 2 * sum(sizes) / len(sizes)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_flow_from_an_evaluate_node(spark):
    rows = spark.range(200).select((F.col("id") % 2).alias("y"), (F.col("id") % 2 * 2.0 + F.rand(1)).alias("x"))
    spec = {
        "data": {"name": "5001", "config": {"parameter": {}, "fileUrl": []}, "pre": [], "next": ["svm", "apply"]},
        "svm": {"name": "6001", "config": {"parameter": {"label": "y", "features": ["x"], "iterations": 5}, "fileUrl": [{"data": 0}]}, "pre": ["data"], "next": ["apply"]},
        "apply": {"name": "6000", "config": {"parameter": {}, "fileUrl": [{"data": 0}, {"svm": 0}]}, "pre": ["data", "svm"], "next": ["judge"]},
        "judge": {"name": "7001", "config": {"parameter": {"label": "y"}, "fileUrl": [{"apply": 0}]}, "pre": ["apply"], "next": []},
    }
    model = training.train_svm(rows, "y", ["x"], iterations=5)
    with pytest.raises(ValueError, match="data"):
        build(spec, start="judge", given={"apply": rows})
    out = build(spec, start="judge", given={"data": rows, "svm": model})
    assert out["judge"].count() > 0


def test_positions_of_large_whole_numbers(spark):
    from tablewright.operators.explore import describe

    df = spark.createDataFrame([(0, 9007199254740993), (1, 9007199254740992), (2, 9007199254740995), (3, 9007199254740994)], "k long, x long")
    row = describe(df, ["x"], order_by="k").first()
    assert (row["min_position"], row["max_position"]) == (1, 2)
