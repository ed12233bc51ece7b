"""Declared flows in the shapes of saved diagrams."""

from __future__ import annotations

import pytest
from pyspark.sql import DataFrame, functions as F

from tablewright.functions import fixed_values as code
from tablewright.operators import rows, training
from tablewright.plans.flow import OPERATORS, build
from tablewright.plans.queries import condition
from tablewright.sources.tables import write_table


def node(name, parents, **parameter):
    return {"name": name, "config": {"parameter": parameter, "fileUrl": [{p: port} for p, port in parents]}}


@pytest.fixture(scope="module")
def data(spark, items):
    flag = (F.col("l_quantity") > 25).cast("int")
    return items.select("*", flag.alias("标签"), F.date_format("l_shipdate", "yyyy/MM/dd").alias("day"), (F.col("l_quantity") - 25.5).alias("q")).cache()


ONE_STEP = {
    "filter": (node(code.FILTER, [("data", 0)], parameter=[condition("l_tax", ">", "0.01")]), None),
    "sort": (node(code.SORT, [("data", 0)], columnName="l_tax", sortType="升序"), None),
    "nested sort": (node(code.SORT, [("data", 0)], parameter={"columnName": "l_tax", "sortType": "降序"}), None),
    "split": (node(code.SPLIT_COLUMN, [("data", 0)], columnName="day", delimiter="/", newColumnNames=["year", "月"]), "月"),
    "split rows": (node(code.SPLIT_ROWS, [("data", 0)], columnName="day", newColumnName="part"), "part"),
    "merge": (node(code.MERGE_COLUMNS, [("data", 0)], columnNames=["l_returnflag", "l_linestatus"], connector="-", newColumnName="m"), "m"),
    "replace": (node(code.REPLACE, [("data", 0)], columnNames=["l_returnflag"], replaceCharacters=[{"source": "R", "target": "back"}]), None),
    "fill": (node(code.FILL_NULLS, [("data", 0)], parameter=[{"operate": "均值填充", "colName": "l_tax"}]), None),
    "map": (node(code.MAP_COLUMNS, [("data", 0)], parameter=[{"colName_1": "l_tax", "operate_1": "+", "value_1": "10", "operate": "*", "colName_2": "l_quantity", "operate_2": "*", "value_2": "0.1", "newName": "n"}]), "n"),
    "bins": (node(code.QUANTILE_BINS, [("data", 0)], columnName="l_tax", newColumnName="b", numBuckets="10"), "b"),
    "index": (node(code.VECTOR_INDEX, [("data", 0)], columnNames=["l_tax"], newColumnName="v", maxCategories=50), "v"),
    "scale": (node(code.STANDARD_SCALE, [("data", 0)], columnNames=["l_tax"], newColumnName="s"), "s"),
    "pca": (node(code.PCA_PROJECT, [("data", 0)], columnNames=["l_tax", "l_discount", "l_quantity"], newColumnName="p", k=2), "p"),
    "string index": (node(code.STRING_INDEX, [("data", 0)], columnName="l_returnflag"), "l_returnflag_string_indexer"),
    "one hot": (node(code.ONE_HOT, [("data", 0)], columnNames=["l_linenumber", "l_linenumber"], newColumnNames=["h1", "h2"]), "h2"),
    "polynomial": (node(code.POLYNOMIAL, [("data", 0)], columnNames=["l_tax", "l_discount"], newColumnName="e"), "e"),
    "chi square": (node(code.CHI_SQUARE, [("data", 0)], columnNames=["l_tax", "l_discount"], columnName_label="l_linenumber", newColumnName="c", numTopFeatures=2), "c"),
    "statistics": (node(code.DESCRIBE, [("data", 0)], columnNames=["l_tax"]), "l_tax"),
    "frequency": (node(code.FREQUENCY, [("data", 0)], columnName="l_returnflag"), "频率"),
    "correlation": (node(code.CORRELATION, [("data", 0)], columnNames=["l_tax", "l_discount"]), "l_discount"),
}


@pytest.mark.parametrize("name", list(ONE_STEP))
def test_one_step(data, name):
    step, column = ONE_STEP[name]
    out = build({"data": node(code.READ, []), "step": step}, {"data": data})["step"]
    assert isinstance(out, DataFrame) and out.count() > 0
    assert column is None or column in out.columns


def test_every_operator_code_is_covered(data):
    steps = {step["name"] for step, _ in ONE_STEP.values()}
    trained = {code.SVM, code.GBT, code.LR_BINARY, code.LR_MULTI, code.MLP, code.RANDOM_SPLIT}
    assert set(OPERATORS) == steps | trained


def test_two_sources_ports_and_reading_files(spark, data, tmp_path):
    path = write_table(data.select("l_tax", "l_quantity"), str(tmp_path / "t"))
    spec = {
        "a": {"name": code.READ, "config": {"fileUrl": [{"a": path}]}, "pre": [""]},
        "parts": node(code.RANDOM_SPLIT, [("a", 0)], proportion1=0.7, proportion2=0.3, seed=10),
        "first": node(code.SORT, [("parts", 0)], columnName="l_tax", sortType=""),
        "second": node(code.SORT, [("parts", 1)], columnName="l_tax"),
    }
    out = build(spec)
    assert out["first"].count() + out["second"].count() == data.count()
    assert out["first"].count() > out["second"].count()


PARAMETERS = {
    code.SVM: {"iterations": 20, "step": 1.0, "regParam": 0.01, "regType": "l2", "convergenceTol": 0.001},
    code.GBT: {"iterations": 2, "step": 0.1, "maxDepth": 3, "minInstancesPerNode": 1, "seed": 1},
    code.LR_BINARY: {"iterations": 5, "regParam": 0.0, "elasticNetParam": 0.0, "tol": 0.000006, "fitIntercept": "True", "threshold": 0.5},
    code.LR_MULTI: {"iterations": 5, "regParam": 0.0, "elasticNetParam": 0.0, "tol": 0.000006, "fitIntercept": "True"},
    code.MLP: {"iterations": 5, "seed": 1, "stepSize": 0.03, "layers": [2, 2, 2], "tol": 0.000001, "blockSize": 128, "solver": "l-bfgs"},
}


@pytest.mark.parametrize("kind", list(PARAMETERS))
def test_train_predict_and_load(spark, data, tmp_path, kind):
    spec = {
        "data": node(code.READ, []),
        "train": node(kind, [("data", 0)], label="标签", features=["q", "l_tax"], **PARAMETERS[kind]),
        "score": node(code.PREDICT, [("data", 0), ("train", 0)], label="标签",
                      features=[data.columns.index("q"), data.columns.index("l_tax")]),
    }
    out = build(spec, {"data": data})
    assert out["score"].count() == data.count()
    path = out["train"].save(str(tmp_path / "m"))
    spec["train"] = node(code.LOAD_MODEL, [], path=path)
    again = build(spec, {"data": data})["score"]
    assert again.exceptAll(out["score"]).count() == 0
    assert build(spec, {"data": data}, models={"train": out["train"]})["score"].count() == data.count()
    if kind in (code.SVM, code.LR_BINARY):
        spec["judge"] = {"name": code.EVALUATE, "config": {"parameter": {"label": "标签"}, "fileUrl": []}, "pre": ["score"]}
        assert [r["指标"] for r in build(spec, {"data": data})["judge"].collect()] == ["正确个数", "精准度", "Area under PR", "Area under ROC"]


def chain():
    return {
        "data": node(code.READ, []),
        "keep": node(code.FILTER, [("data", 0)], parameter=[condition("l_tax", ">", "0.01")]),
        "count": node(code.FREQUENCY, [("keep", 0)], columnName="l_returnflag"),
        "other": node(code.FREQUENCY, [("keep", 0)], columnName="l_linestatus"),
    }


def test_start_from_a_node(data):
    kept = rows.filter_rows(data, [condition("l_tax", ">", "0.01")])
    out = build(chain(), start="count", given={"keep": kept})
    assert set(out) == {"keep", "count"}
    assert out["count"].collect() == build(chain(), {"data": data})["count"].collect()
    with pytest.raises(ValueError):
        build(chain(), start="count")
    with pytest.raises(ValueError):
        build(chain(), start="nowhere")


def test_shared_tables_can_be_kept(data):
    out = build(chain(), {"data": data.select("*")}, persist_shared=True)
    assert out["keep"].is_cached and not out["count"].is_cached
    out["keep"].unpersist()


@pytest.mark.parametrize(
    "spec",
    [
        {"a": node(9999, [])},
        {"a": node(code.READ, [])},
        {"a": node(code.SORT, [("b", 0)], columnName="x")},
        {"a": node(code.SORT, [("b", 0)], columnName="x"), "b": node(code.SORT, [("a", 0)], columnName="x")},
        {"a": node(code.SORT, [], columnName="x")},
        {"a": node(code.PREDICT, [])},
        {"a": node(code.EVALUATE, [], label="x")},
    ],
)
def test_broken_flows_raise(spark, spec):
    with pytest.raises(ValueError):
        build(spec)
