"""The registered queries: every operator run over the whole of the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablewright.functions import fixed_values as code
from tablewright.functions.fixed_values import FILL_MAX, FILL_MEAN, FILL_MIN, METRIC_LABEL, VALUE_LABEL
from tablewright.operators import explore, features, mining, reshape, rows, scoring, training
from tablewright.plans.flow import build
from tablewright.sources import tables
from tablewright.sources.scratch import scratch_path

Query = Callable[[SparkSession, str], DataFrame]

INPUTS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tables.read_table(spark, f"{sf_dir}/{name}.parquet")


def _six(column: str | Column, alias: str, digits: int = 6) -> Column:
    value = F.col(column) if isinstance(column, str) else column
    return F.round(value.cast("double"), digits).alias(alias)


def _element(array: str, i: int, alias: str, digits: int | None = None) -> Column:
    value = F.get(F.col(array), F.lit(i)).cast("double")
    return value.alias(alias) if digits is None else _six(value, alias, digits)


def _day(column: str) -> Column:
    return F.date_format(F.col(column), "yyyy-MM-dd")


def condition(column: str, operate: str, value: str, relation: str = "") -> dict[str, str]:
    return {"colName": column, "operate": operate, "value": value, "relation": relation}


# --- sources and table access -----------------------------------------------------------------


def csv_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "customer")
    tables.write_table(table(spark, sf_dir, "customer"), path, format="csv")
    return tables.read_table(spark, path, format="csv").select(
        F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"
    )


def csv_text_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "supplier")
    tables.write_table(table(spark, sf_dir, "supplier"), path, format="csv")
    return tables.read_table(spark, path, format="csv", infer=False)


def csv_headerless(spark, sf_dir):
    path = scratch_path(spark, "part")
    table(spark, sf_dir, "part").write.csv(path)
    return tables.read_table(spark, path, format="csv", header=False, infer=False)


def json_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "orders")
    orders = table(spark, sf_dir, "orders")
    tables.write_table(orders, path, format="json")
    return tables.read_table(spark, path, format="json", schema=orders.schema)


def text_length(spark, sf_dir):
    return tables.text_length(table(spark, sf_dir, "documents"), "text")


def preview_slice(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    return tables.preview(orders, 100, 150, order_by="o_orderkey")


def preview_deep(spark, sf_dir):
    """A twentieth of all line items, four fifths down in the order of a key of five columns."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate")
    rows = items.count()
    return tables.preview(items, rows - rows // 5, rows - rows // 5 + rows // 20, order_by=["l_shipdate", "l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey"])


def head_json(spark, sf_dir):
    return tables.head_json(table(spark, sf_dir, "orders"))


def column_listing(spark, sf_dir):
    return tables.column_listing(table(spark, sf_dir, "events"))


def column_listing_numeric(spark, sf_dir):
    return tables.column_listing(table(spark, sf_dir, "lineitem"), numeric_only=True)


# --- rows and columns -------------------------------------------------------------------------

FILTER = [
    condition("l_quantity", ">", "30", "AND"),
    condition("l_returnflag", "==", "R", "OR"),
    condition("l_discount", ">=", "0.09", "AND"),
    condition("l_linestatus", "!=", "F"),
]


def filter_multi(spark, sf_dir):
    kept = rows.filter_rows(table(spark, sf_dir, "lineitem"), FILTER)
    return kept.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag", "l_linestatus")


def filter_patterns(spark, sf_dir):
    conditions = [
        condition("p_name", "LIKE", "s%", "AND"),
        condition("p_size", "<=", "25", "OR"),
        condition("p_type", "RLIKE", "^(ECO|PRO)", "AND"),
        condition("p_retailprice", "<", "1000.5"),
    ]
    return rows.filter_rows(table(spark, sf_dir, "part"), conditions)


def filter_dates(spark, sf_dir):
    conditions = [
        condition("o_orderdate", ">=", "1997-06-01", "AND"),
        condition("o_orderdate", "<", "1998-06-01 00:00:00", "AND"),
        condition("o_orderstatus", "<>", "P"),
    ]
    kept = rows.filter_rows(table(spark, sf_dir, "orders"), conditions)
    return kept.select("o_orderkey", "o_orderstatus", _day("o_orderdate").alias("day"))


def filter_number_in_text(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))
    return rows.filter_rows(events, [condition("k", ">", "49.5")])


def filter_chain(spark, sf_dir):
    steps = [
        [condition("o_totalprice", ">", "50000", "AND"), condition("o_orderstatus", "=", "O")],
        [condition("o_orderpriority", "==", "1-URGENT", "OR"), condition("o_orderpriority", "==", "5-LOW")],
        [condition("o_totalprice", "<=", "400000")],
    ]
    kept = rows.filter_chain(table(spark, sf_dir, "orders"), steps)
    return kept.select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")


def sort_desc(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return rows.sort_rows(orders, "o_totalprice", code.DESCENDING)


def sort_top(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return rows.sort_rows(orders, "o_orderkey", code.DESCENDING).limit(20)


def sort_asc_nulls(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", F.when(F.col("l_linenumber") % 3 != 0, F.col("l_discount")).alias("discount")
    )
    return rows.sort_rows(items, "discount", code.ASCENDING)


def split_column(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", _day("o_orderdate").alias("day"))
    named = reshape.split_column(orders, "day", "-", ["year", "month"])
    return reshape.split_column(named, "o_orderpriority", "-", ["rank", "word", "missing"])


def split_column_auto(spark, sf_dir):
    return reshape.split_column(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_name", "#")


def split_rows(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return reshape.split_rows(orders, "o_orderpriority", "piece")


def split_rows_delimiter(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    lines = reshape.split_rows(documents, "text", "sentence", delimiter=". ")
    return lines.select("doc_id", "sentence")


def merge_columns(spark, sf_dir):
    parts = table(spark, sf_dir, "part").withColumn(
        "p_type", F.when(F.col("p_size") > 10, F.col("p_type"))
    )
    merged = reshape.merge_columns(parts, ["p_type", "p_brand", "p_name"], "-", "full_name")
    return merged.select("p_partkey", "full_name")


def replace_values(spark, sf_dir):
    pairs = [
        {"source": "MACHINERY|FURNITURE", "target": "GOODS"},
        {"source": "Customer#0*([0-9]+)", "target": "customer $1"},
        {"source": "GOODS", "target": "goods copy"},
    ]
    customers = table(spark, sf_dir, "customer")
    return reshape.replace_values(customers, ["c_mktsegment", "c_name", "c_nationkey"], pairs)


def _with_gaps(spark, sf_dir):
    gap = F.col("l_linenumber") % 3 == 0
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        F.when(~gap, F.col("l_discount")).alias("discount"),
        F.when(~gap, F.col("l_linenumber")).alias("line"),
        F.when(gap, F.lit(float("nan"))).otherwise(F.col("l_tax")).alias("tax"),
    )


def _filled(spark, sf_dir, how):
    entries = [{"colName": c, "operate": how} for c in ("discount", "line", "tax")]
    filled = reshape.fill_nulls(_with_gaps(spark, sf_dir), entries)
    return filled.select("l_orderkey", "l_partkey", _six("discount", "discount"), "line", _six("tax", "tax"))


def fill_nulls_mean(spark, sf_dir):
    return _filled(spark, sf_dir, FILL_MEAN)


def fill_nulls_max(spark, sf_dir):
    return _filled(spark, sf_dir, FILL_MAX)


def fill_nulls_min(spark, sf_dir):
    return _filled(spark, sf_dir, FILL_MIN)


MAP = [
    {"colName_1": "l_extendedprice", "operate_1": "+", "value_1": "100", "operate": "+",
     "colName_2": "l_quantity", "operate_2": "*", "value_2": "0.0001", "newName": "shifted"},
    {"colName_1": "l_linenumber", "operate_1": "*", "value_1": "0.5", "operate": "/",
     "colName_2": "l_tax", "operate_2": "*", "value_2": "100", "newName": "ratio"},
    {"colName_1": "l_quantity", "operate_1": "/", "value_1": "0", "operate": "",
     "colName_2": "", "operate_2": "", "value_2": "", "newName": "nothing"},
    {"colName_1": "shifted", "operate_1": "-", "value_1": "1", "operate": "",
     "colName_2": None, "newName": "again"},
]


def map_columns(spark, sf_dir):
    mapped = reshape.map_columns(table(spark, sf_dir, "lineitem"), MAP)
    return mapped.select(
        "l_orderkey", "l_partkey", _six("shifted", "shifted", 5), _six("ratio", "ratio"),
        "nothing", _six("again", "again", 5),
    )


def random_split(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    first, second = rows.random_split(orders, 0.7, 0.3, seed=10)
    return first.unionByName(second)


def hash_split(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    first, second = rows.hash_split(orders, "o_orderkey", 0.7, 0.3)
    return first.withColumn("port", F.lit(0)).unionByName(second.withColumn("port", F.lit(1)))


def scatter_sample(spark, sf_dir):
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return rows.scatter_sample(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"], seed=7, key=key)


# --- exploration ------------------------------------------------------------------------------


def _rounded_statistics(described: DataFrame) -> DataFrame:
    digits = {"min": 6, "max": 6, "q25": 4, "median": 4, "q75": 4, "mean": 4, "mean_abs_dev": 4,
              "variance": 1, "std": 4, "skewness": 6, "kurtosis": 6}
    return described.select(
        "column", "type", "count", "min_position", "max_position",
        *[_six(name, name, d) for name, d in digits.items()],
    )


def describe(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(
        "l_quantity", "l_extendedprice", "l_returnflag", "l_linenumber",
        F.when(F.col("l_linenumber") % 3 != 0, F.col("l_discount")).alias("discount"),
    )
    return _rounded_statistics(explore.describe(items, items.columns))


def describe_positions(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return _rounded_statistics(explore.describe(events, ["value", "user_id", "event_type"], order_by="event_id"))


def describe_report(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    report = explore.describe_report(orders, ["o_custkey", "o_orderstatus"], order_by="o_orderkey")
    number = F.col("o_custkey").try_cast("double")
    shown = F.when(F.abs(number) >= 100, F.round(number, 1)).otherwise(F.round(number, 6))
    return report.select("statistic", F.when(number.isNull(), F.col("o_custkey")).alias("word"), shown.alias("number"), "o_orderstatus")


def frequency(spark, sf_dir):
    return explore.frequency(table(spark, sf_dir, "events"), "event_type")


def frequency_nulls(spark, sf_dir):
    gaps = _with_gaps(spark, sf_dir)
    return explore.frequency(gaps.withColumn("line", F.col("line").cast("long")), "line", "rows")


def _correlated(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_quantity",
        "l_extendedprice",
        F.when(F.col("l_linenumber") % 3 != 0, F.col("l_discount")).alias("discount"),
        F.when(F.col("l_linenumber") % 2 != 0, F.col("l_tax")).alias("tax"),
        F.lit(1.5).alias("same"),
    )


def correlation(spark, sf_dir):
    long = explore.correlation(_correlated(spark, sf_dir), ["l_quantity", "l_extendedprice", "discount", "tax", "same"])
    return long.select("left", "right", _six("correlation", "correlation"))


def correlation_matrix(spark, sf_dir):
    matrix = explore.correlation_matrix(_correlated(spark, sf_dir), ["l_extendedprice", "discount", "tax"])
    return matrix.select("column", *[_six(c, c) for c in ("l_extendedprice", "discount", "tax")])


# --- features ---------------------------------------------------------------------------------


def assemble_array(spark, sf_dir):
    items = features.assemble_array(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"], "point")
    return items.select("l_orderkey", "l_partkey", _element("point", 0, "x"), _element("point", 1, "y"))


def quantile_bins(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice")
    return features.quantile_bins(items, "l_extendedprice", "bin", 10, relative_error=0.0)


def quantile_bins_ties(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_tax")
    return features.quantile_bins(items, "l_tax", "bin", 20, relative_error=0.0)


def quantile_bins_approx(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice")
    return features.quantile_bins(items, "l_extendedprice", None, 10).withColumnRenamed(
        "l_extendedprice" + code.QUANTILE_SUFFIX, "bin"
    )


def vector_index(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_tax", "l_quantity")
    indexed = features.vector_index(items, ["l_linenumber", "l_tax", "l_quantity"], "v", 20)
    return indexed.select(
        "l_orderkey", "l_partkey", _element("v", 0, "line"), _element("v", 1, "tax"), _element("v", 2, "quantity")
    )


def standard_scale(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_discount")
    scaled = features.standard_scale(items, ["l_quantity", "l_discount"], "v")
    return scaled.select("l_orderkey", "l_partkey", _element("v", 0, "quantity", 4), _element("v", 1, "discount", 4))


def standard_scale_centred(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    scaled = features.standard_scale(items, ["l_quantity"], "v", with_mean=True)
    return scaled.select("l_orderkey", "l_partkey", _element("v", 0, "quantity", 5))


def pca(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_discount", "l_tax")
    projected = features.pca(items, ["l_discount", "l_tax"], "v", 1)
    return projected.select("l_orderkey", "l_partkey", _six(F.abs(F.get("v", F.lit(0)).cast("double")), "length", 5))


def pca_variance(spark, sf_dir):
    shares = features.pca_variance(table(spark, sf_dir, "lineitem"), ["l_discount", "l_tax"], 1)
    return shares.select("component", _six("explained_variance", "explained_variance"))


def pca_variance_all(spark, sf_dir):
    shares = features.pca_variance(table(spark, sf_dir, "lineitem"), [*INPUTS, "l_linenumber"], 4)
    return shares.select("component", _six("explained_variance", "explained_variance"))


def string_index(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return features.string_index(customers, "c_mktsegment", "segment_index")


def string_index_join(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return features.string_index(items, "l_partkey", "part_index", label_limit=100)


def string_index_fitted(spark, sf_dir):
    """An index learned from one half of the line items, saved, loaded and applied to all of them."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    fitted = features.fit_string_index(items.where("l_linenumber <= 3"), "l_partkey", "part_index", handle_invalid="keep", label_limit=100)
    path = fitted.save(scratch_path(spark, "part-index"))
    return features.load_feature(spark, path).transform(items)


def scaled_and_saved(spark, sf_dir):
    """A scaling learned from early orders, saved, loaded and applied to all line items."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_tax")
    fitted = features.fit_standard_scale(items.where("l_orderkey % 3 = 0"), ["l_quantity", "l_tax"], "v", with_mean=True)
    scaled = features.load_feature(spark, fitted.save(scratch_path(spark, "scale"))).transform(items)
    return scaled.select("l_orderkey", "l_partkey", _element("v", 0, "quantity", 5), _element("v", 1, "tax", 5))


def one_hot(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    encoded = features.one_hot(items, ["l_linenumber", "l_linenumber"], ["a", "b"], as_array=True)
    return encoded.select(
        "l_orderkey", "l_partkey", *[_element("a", i, f"a{i}") for i in range(7)], F.size("b").alias("width")
    )


def polynomial(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_discount", "l_tax")
    expanded = features.polynomial(items, ["l_quantity", "l_discount", "l_tax"], "v")
    names = ["x", "xx", "y", "xy", "yy", "z", "xz", "yz", "zz"]
    return expanded.select("l_orderkey", "l_partkey", *[_element("v", i, n) for i, n in enumerate(names)])


def _flagged(spark, sf_dir):
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return table(spark, sf_dir, "lineitem").withColumn("flag", flag)


def chi_square_scores(spark, sf_dir):
    scores = features.chi_square_scores(_flagged(spark, sf_dir), ["l_linenumber", "l_quantity", "l_tax"], "flag")
    return scores.select("column", _six("statistic", "statistic", 4), "degrees_of_freedom", _six("p_value", "p_value", 8))


def chi_square(spark, sf_dir):
    items = _flagged(spark, sf_dir).withColumn(
        "near_flag", F.when(F.col("l_linenumber") == 1, F.lit(0)).otherwise(F.col("flag"))
    )
    kept = features.chi_square(items, ["l_linenumber", "l_quantity", "near_flag"], "flag", "v", 1)
    return kept.select("l_orderkey", "l_partkey", _element("v", 0, "selected"), F.size("v").alias("width"))


# --- models -----------------------------------------------------------------------------------


def _big(spark, sf_dir):
    """Line items with classes that one column decides, so that a right model recovers them."""
    quantity = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select(
        "*",
        (quantity - 25.5).alias("above_middle"),
        F.when(quantity > 25, 1).otherwise(0).alias("is_big"),
        F.when(quantity > 25, 1).otherwise(0).bitwiseXOR((F.col("l_partkey") % 7 == 0).cast("int")).alias("noisy"),
        F.when(F.col("l_linenumber") > 3, "late").otherwise("early").alias("half"),
        F.when(quantity > 34, 2).when(quantity > 17, 1).otherwise(0).alias("third"),
    )


def _grouped(spark, sf_dir):
    """Line items in three classes that follow the line number, but for a tenth of the rows; features mark the line number."""
    clean = F.when(F.col("l_linenumber") <= 2, 0).when(F.col("l_linenumber") <= 4, 1).otherwise(2)
    flag = F.when(F.col("l_partkey") % 10 == 0, (clean + 1) % 3).otherwise(clean)
    marks = [(F.col("l_linenumber") == i).cast("double").alias(f"line{i}") for i in range(1, 8)]
    return table(spark, sf_dir, "lineitem").select(flag.alias("flag"), *marks)


LINES = [f"line{i}" for i in range(1, 8)]


def _whole(scored: DataFrame, names: list[str]) -> DataFrame:
    """All of a scored table, the features as columns of their own."""
    parts = scored.withColumn("features", vector_to_array("features"))
    rest = [c for c in scored.columns if c != "features"]
    return parts.select(*rest, *[_element("features", i, name, 6) for i, name in enumerate(names)])


def _reloaded(spark, trained):
    return training.load_model(spark, trained.save(scratch_path(spark, trained.kind)))


def svm_binary(spark, sf_dir):
    items = _big(spark, sf_dir)
    trained = training.train_svm(items, "is_big", ["above_middle", "l_tax"], iterations=20, step=1.0,
                                 reg_param=0.01, reg_type="l2", convergence_tol=0.001)
    return scoring.predict(_reloaded(spark, trained), items, label="is_big")


def svm_owlqn(spark, sf_dir):
    items = _big(spark, sf_dir)
    trained = training.train_svm(items, "is_big", ["above_middle", "l_tax"], iterations=20, engine="owlqn")
    return scoring.predict(_reloaded(spark, trained), items, label="is_big")


def gbt_binary(spark, sf_dir):
    items = _big(spark, sf_dir)
    trained = training.train_gbt(items, "half", ["l_linenumber", "l_discount", "l_tax"],
                                 iterations=20, step=0.1, max_depth=5, min_instances_per_node=1, seed=1)
    return _whole(scoring.predict(_reloaded(spark, trained), items, label="half"), ["l_linenumber", "l_discount", "l_tax"])


def lr_binary(spark, sf_dir):
    items = _big(spark, sf_dir)
    trained = training.train_lr(items, "is_big", ["above_middle", "l_tax"], iterations="20", reg_param=0.0,
                                elastic_net_param=0.0, tol=0.000006, fit_intercept="True", threshold=0.5)
    return _whole(scoring.predict(_reloaded(spark, trained), items, label="is_big"), ["above_middle", "l_tax"])


def lr_multi(spark, sf_dir):
    items = _grouped(spark, sf_dir)
    trained = training.train_lr_multi(items, "flag", LINES, iterations=20, tol=0.000006)
    return _whole(scoring.predict(_reloaded(spark, trained), items, label="flag"), LINES)


def mlp_multi(spark, sf_dir):
    items = _grouped(spark, sf_dir)
    trained = training.train_mlp(items, "flag", LINES, layers=[7, 6, 3], iterations=60, seed=1)
    return _whole(scoring.predict(_reloaded(spark, trained), items, label="flag"), LINES)


def rf_multi(spark, sf_dir):
    items = _big(spark, sf_dir)
    trained = training.train_forest(items, "third", ["l_quantity", "l_discount"], num_trees=50, max_depth=5,
                                    max_bins=64, seed=1)
    return _whole(scoring.predict(_reloaded(spark, trained), items, label="third"), ["l_quantity", "l_discount"])


def predict_by_ordinal(spark, sf_dir):
    items = _big(spark, sf_dir)
    trained = training.train_svm(items, "is_big", ["above_middle", "l_tax"], iterations=20)
    ordinals = [items.columns.index(name) for name in ("above_middle", "l_tax")]
    return scoring.predict(trained, items, features=ordinals)


def _scored_rule(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("label"),
        F.when(F.col("l_quantity") > 25, 1.0).otherwise(0.0).alias("prediction"),
        F.col("l_quantity").alias("score"),
    )


def _metrics(report: DataFrame) -> DataFrame:
    return report.select(F.col(METRIC_LABEL).alias("metric"), _six(VALUE_LABEL, "value", 8))


def binary_metrics_hard(spark, sf_dir):
    return _metrics(scoring.binary_metrics(_scored_rule(spark, sf_dir), "label", "prediction"))


def binary_metrics_raw(spark, sf_dir):
    return _metrics(scoring.binary_metrics(_scored_rule(spark, sf_dir), "label", "prediction", "score"))


def multiclass_metrics(spark, sf_dir):
    guess = F.when(F.col("l_quantity") > 34, "A").when(F.col("l_quantity") > 17, "N").otherwise("R")
    items = table(spark, sf_dir, "lineitem").select("l_returnflag", guess.alias("guess"))
    return _metrics(scoring.multiclass_metrics(items, "l_returnflag", "guess"))


def evaluate_svm(spark, sf_dir):
    items = _big(spark, sf_dir)
    trained = training.train_svm(items, "noisy", ["above_middle"], iterations=20, keep="best")
    return _metrics(scoring.evaluate(trained, items, "noisy"))


def evaluate_lr(spark, sf_dir):
    items = _big(spark, sf_dir)
    trained = training.train_lr(items, "noisy", ["above_middle"], iterations=20)
    return _metrics(scoring.evaluate(trained, items, "noisy"))


def evaluate_lr_raw(spark, sf_dir):
    items = _big(spark, sf_dir)
    trained = training.train_lr(items, "noisy", ["above_middle"], iterations=20)
    return _metrics(scoring.evaluate(trained, items, "noisy", score="raw"))


def evaluate_forest(spark, sf_dir):
    items = _big(spark, sf_dir)
    trained = training.train_forest(items, "noisy", ["l_quantity"], num_trees=3, max_depth=4, max_bins=64, seed=1)
    scored = scoring.predict(_reloaded(spark, trained), items, label="noisy")
    return _metrics(scoring.binary_metrics(scored, "label", "predicted_label"))


def feature_importance(spark, sf_dir):
    trained = training.train_gbt(_big(spark, sf_dir), "half", ["l_linenumber", "l_discount"], iterations=20, seed=1)
    return training.feature_importances(trained).select("feature", _six("importance", "importance"))


def model_inspect(spark, sf_dir):
    trained = training.train_lr(_flagged(spark, sf_dir).withColumn("r", (F.col("flag") == 2).cast("int")), "r", INPUTS, iterations=20)
    return training.inspect_model(trained)


def model_parameters(spark, sf_dir):
    """A saved model's columns and training parameters, and its metrics on a table that it hasn't seen."""
    items = _big(spark, sf_dir)
    trained = training.train_lr(items.where("l_orderkey % 2 = 0"), "noisy", ["above_middle"], iterations=20, elastic_net_param=0.5, threshold=0.5)
    report = scoring.model_report(_reloaded(spark, trained), items.where("l_orderkey % 2 = 1"), "noisy")
    number = F.col("value").try_cast("double")
    return report.select("section", "term", F.when(number.isNull(), F.col("value")).alias("word"), F.round(number, 8).alias("number"))


def lenient_features(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("value", "event_type", F.get_json_object("props", "$.k").alias("k"))
    return training.lenient_features(events, ["value", "k"], "event_type")


# --- mining -----------------------------------------------------------------------------------


def frequent_items(spark, sf_dir):
    baskets = (
        table(spark, sf_dir, "events")
        .groupBy("user_id", F.to_date("ts").alias("day"))
        .agg(F.collect_set("event_type").alias("items"))
    )
    found = mining.frequent_itemsets(baskets, "items", min_support=0.05)
    return found.select(F.array_join("items", ",").alias("items"), "freq")


def frequent_sequences(spark, sf_dir):
    steps = F.transform(F.split("url", "/"), lambda step: F.array(step))
    pages = table(spark, sf_dir, "pages").select(steps.alias("sequence"))
    found = mining.frequent_sequences(pages, "sequence", min_support=0.05, max_pattern_length=3)
    shown = F.array_join(F.transform("sequence", lambda items: F.array_join(items, ",")), ">")
    return found.select(shown.alias("pattern"), "freq")


# --- flows ------------------------------------------------------------------------------------


def _flow(path: str) -> dict:
    return {
        "data": {"name": code.READ, "config": {"fileUrl": [{"data": path}]}, "next": ["keep"], "pre": [""]},
        "keep": {"name": code.FILTER, "config": {"parameter": {"parameter": FILTER}, "fileUrl": [{"data": 0}]},
                 "next": ["calc"], "pre": ["data"]},
        "calc": {"name": code.MAP_COLUMNS,
                 "config": {"parameter": {"parameter": [
                     {"colName_1": "l_quantity", "operate_1": "*", "value_1": "2", "operate": "+",
                      "colName_2": "l_linenumber", "operate_2": "+", "value_2": "0.5", "newName": "score"}]},
                     "fileUrl": [{"keep": 0}]},
                 "next": ["count"], "pre": ["keep"]},
        "count": {"name": code.FREQUENCY, "config": {"parameter": {"columnName": "score"}, "fileUrl": [{"calc": 0}]},
                  "next": [], "pre": ["calc"]},
    }


def flow_demo(spark, sf_dir):
    return build(_flow(f"{sf_dir}/lineitem.parquet"))["count"].withColumnRenamed(code.FREQUENCY_LABEL, "rows")


def flow_from_node(spark, sf_dir):
    kept = rows.filter_rows(table(spark, sf_dir, "lineitem"), FILTER)
    spec = _flow(f"{sf_dir}/lineitem.parquet")
    return build(spec, start="calc", given={"keep": kept})["count"].withColumnRenamed(code.FREQUENCY_LABEL, "rows")


def flow_evaluate(spark, sf_dir):
    spec = {
        "data": {"name": code.READ, "config": {}, "next": ["train", "score"], "pre": []},
        "train": {"name": code.SVM,
                  "config": {"parameter": {"label": "noisy", "features": ["above_middle"], "iterations": 20,
                                           "step": 1.0, "regParam": 0.01, "regType": "l2", "convergenceTol": 0.001, "keep": "best"},
                             "fileUrl": [{"data": 0}]},
                  "next": ["score"], "pre": ["data"]},
        "score": {"name": code.PREDICT,
                  "config": {"parameter": {"label": "noisy", "features": ["above_middle"]},
                             "fileUrl": [{"data": 0}, {"train": 0}]},
                  "next": ["judge"], "pre": ["train", "data"]},
        "judge": {"name": code.EVALUATE, "config": {"parameter": {"label": "noisy"}, "fileUrl": []},
                  "next": [], "pre": ["score"]},
    }
    return _metrics(build(spec, {"data": _big(spark, sf_dir)})["judge"])


QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in (
        csv_roundtrip, csv_text_roundtrip, csv_headerless, json_roundtrip, text_length, preview_slice, preview_deep, head_json,
        column_listing, column_listing_numeric, filter_multi, filter_patterns, filter_dates, filter_number_in_text,
        filter_chain, sort_desc, sort_top, sort_asc_nulls, split_column, split_column_auto, split_rows,
        split_rows_delimiter, merge_columns, replace_values, fill_nulls_mean, fill_nulls_max, fill_nulls_min,
        map_columns, random_split, hash_split, scatter_sample, describe, describe_positions, describe_report,
        frequency, frequency_nulls, correlation, correlation_matrix, assemble_array, quantile_bins,
        quantile_bins_ties, quantile_bins_approx, vector_index, standard_scale, standard_scale_centred, pca,
        pca_variance, pca_variance_all, string_index, string_index_join, string_index_fitted,
        scaled_and_saved, one_hot, polynomial, chi_square_scores,
        chi_square, svm_binary, svm_owlqn, gbt_binary, lr_binary, lr_multi, mlp_multi, rf_multi, predict_by_ordinal,
        binary_metrics_hard, binary_metrics_raw, multiclass_metrics, evaluate_svm, evaluate_lr, evaluate_lr_raw,
        evaluate_forest, feature_importance, model_inspect, model_parameters, lenient_features, frequent_items, frequent_sequences, flow_demo, flow_from_node, flow_evaluate,
    )
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter, compute and count as one declared flow."""
    return flow_demo(spark, sf_dir)
