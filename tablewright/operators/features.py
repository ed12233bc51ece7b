"""Feature engineering: fitted once, applied to any table with the same columns.

Operators that learn from the table have a `fit_*` function for the fitted feature and a plain one
that fits and transforms the same table. Vectors come out as arrays of float.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass, replace
from functools import reduce
from itertools import combinations_with_replacement
from typing import NamedTuple

from pyspark.ml import Model, PipelineModel, Transformer
from pyspark.ml.feature import (
    PCA,
    Bucketizer,
    OneHotEncoder,
    QuantileDiscretizer,
    StandardScaler,
    StringIndexerModel,
    VectorAssembler,
    VectorIndexer,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tablewright.functions.columns import (
    balanced,
    clean_double,
    elements,
    free_name,
    is_vector,
    quoted,
    require_numeric,
    resolve,
    resolve_all,
    width,
)
from tablewright.functions.fixed_values import (
    CHI_SQUARE_NAME,
    ONE_HOT_SUFFIX,
    PCA_NAME,
    POLYNOMIAL_SUFFIX,
    QUANTILE_SUFFIX,
    SCALE_SUFFIX,
    STRING_INDEX_SUFFIX,
    VECTOR_INDEX_SUFFIX,
)
from tablewright.functions.moments import chi_square_tail
from tablewright.operators.quantiles import exact_quantiles
from tablewright.operators.ranking import with_position
from tablewright.sources.layout import held
from tablewright.sources.scratch import scratch_path

# Labels that a string index may keep in a model on the driver; more are joined as a table.
LABEL_LIMIT = 100_000
# A label above this share of the rows is matched by a broadcast; fewer than 1 / share can be.
HOT_SHARE = 1e-4
# A one-hot array has at most so many places in every row.
ONE_HOT_WIDTH = 10_000


@dataclass(frozen=True)
class State:
    """What a fitted feature has learned, apart from any session: input columns with their types and widths, and numbers."""

    kind: str
    output: str
    names: list[str]
    schema: dict
    widths: dict[str, int]
    handle_invalid: str
    numbers: dict

    def inputs(self, spark: SparkSession) -> tuple[list[Column], Column | None]:
        blank = spark.createDataFrame([], T.StructType.fromJson(self.schema))
        return _inputs(blank, self.names, self.handle_invalid, self.widths)


@dataclass(frozen=True)
class FittedFeature:
    """New columns as expressions of a table's columns, and the fitted model behind them.

    The expressions are made from the model's parameters, so applying a feature is an ordinary
    projection. `filter` keeps the rows without missing inputs where these are to be skipped.
    """

    columns: dict[str, Column]
    model: Model | Transformer | None = None
    filter: Column | None = None
    state: State | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        kept = df if self.filter is None else df.where(self.filter)
        return kept.withColumns(self.columns)

    def save(self, path: str, overwrite: bool = True) -> str:
        return save_feature(self, path, overwrite=overwrite)


@dataclass(frozen=True)
class FittedStage:
    """A fitted Spark ML stage that writes its own output columns, arrays included."""

    model: Model | Transformer

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df)

    def save(self, path: str, overwrite: bool = True) -> str:
        return save_feature(self, path, overwrite=overwrite)


@dataclass(frozen=True)
class FittedStringIndex:
    """A string index of any number of labels: a table of label, rows and index in shared storage.

    Labels above HOT_SHARE of the rows, of which there are fewer than 1 / HOT_SHARE, meet their rows by broadcast; rows
    of the others are dealt out by label and joined.
    """

    labels: DataFrame
    rows: int
    size: int
    column: str
    output: str
    handle_invalid: str

    def transform(self, df: DataFrame) -> DataFrame:
        return _join_labels(df, self)

    def save(self, path: str, overwrite: bool = True) -> str:
        return save_feature(self, path, overwrite=overwrite)


Fitted = FittedFeature | FittedStage | FittedStringIndex
_FEATURE_SCHEMA = "kind string, state string"


def save_feature(fitted: Fitted, path: str, *, overwrite: bool = True) -> str:
    """Save a fitted feature to a directory: what it learned as one row, a label table or a model beside it."""
    spark = SparkSession.active()
    mode = "overwrite" if overwrite else "errorifexists"
    if isinstance(fitted, FittedStage):
        writer = PipelineModel([fitted.model]).write()
        (writer.overwrite() if overwrite else writer).save(f"{path}/model")
        kind, state = "stage", {}
    elif isinstance(fitted, FittedStringIndex):
        fitted.labels.write.mode(mode).parquet(f"{path}/labels")
        kind, state = "labels", {k: getattr(fitted, k) for k in ("rows", "size", "column", "output", "handle_invalid")}
    elif fitted.state is not None:
        kind, state = fitted.state.kind, asdict(fitted.state)
    else:
        raise ValueError("this feature has no state to save")
    meta = spark.createDataFrame([(kind, json.dumps(state, ensure_ascii=False))], _FEATURE_SCHEMA)
    meta.coalesce(1).write.mode(mode).json(f"{path}/feature")
    return path


def load_feature(spark: SparkSession, path: str) -> Fitted:
    """Load what `save_feature` wrote; it gives the same columns as the feature that was saved."""
    meta = spark.read.schema(_FEATURE_SCHEMA).json(f"{path}/feature").head()
    state = json.loads(meta["state"])
    if meta["kind"] == "stage":
        return FittedStage(PipelineModel.load(f"{path}/model").stages[0])
    if meta["kind"] == "labels":
        return FittedStringIndex(spark.read.parquet(f"{path}/labels"), **state)
    return _built(spark, State(**state))


def _state(df: DataFrame, kind: str, output: str, names: Sequence[str], handle_invalid: str, **numbers) -> State:
    """The state of a feature on the table's columns; the widths of feature columns are looked up once."""
    own = list(dict.fromkeys(names))
    schema = T.StructType([df.schema[name] for name in own]).jsonValue()
    widths = {name: width(df, name) for name in own if is_vector(df, name)}
    return State(kind, output, list(names), schema, widths, handle_invalid, numbers)


def _built(spark: SparkSession, state: State, model: Model | Transformer | None = None) -> FittedFeature:
    """The feature's columns, from its state alone."""
    if state.kind == "one_hot":
        return FittedFeature(_units(state.names, **state.numbers), model, None, state)
    inputs, present = state.inputs(spark)
    return FittedFeature({state.output: _KINDS[state.kind](inputs, **state.numbers)}, model, present, state)


def assemble(
    df: DataFrame, columns: Sequence[str | int], new_column: str, handle_invalid: str = "error"
) -> DataFrame:
    """Numeric columns, vectors and arrays as one vector column; `handle_invalid` is error, skip or keep."""
    names, own = resolve_all(df, columns), []
    require_numeric(df, [name for name in names if not is_vector(df, name)])
    wide = df
    for name in names:
        if is_vector(df, name) and isinstance(df.schema[name].dataType, T.ArrayType):
            own.append(free_name(wide, f"{name}_vector"))
            wide = wide.withColumn(own[-1], array_to_vector(quoted(name).cast("array<double>")))
            names = [own[-1] if x == name else x for x in names]
    assembler = VectorAssembler(inputCols=names, outputCol=new_column, handleInvalid=handle_invalid)
    return assembler.transform(wide).drop(*own)


def assemble_array(
    df: DataFrame, columns: Sequence[str | int], new_column: str, handle_invalid: str = "error"
) -> DataFrame:
    """Numeric columns as one array of float."""
    inputs, present = _inputs(df, columns, handle_invalid)
    return FittedFeature({new_column: _floats(inputs)}, filter=present).transform(df)


def to_array(column: str) -> Column:
    """A vector column as an array of float; null stays null."""
    return vector_to_array(quoted(column), "float32")


def _floats(values: Sequence[Column]) -> Column:
    return F.array(*[value.cast("float") for value in values])


def _inputs(
    df: DataFrame, columns: Sequence[str | int], handle_invalid: str, widths: Mapping[str, int] | None = None
) -> tuple[list[Column], Column | None]:
    """The columns as doubles without nulls, and the filter that skips rows with missing values."""
    values: list[Column] = []
    names: list[str] = []
    for name in resolve_all(df, columns):
        if is_vector(df, name):
            found = [F.when(~F.isnan(x), x) for x in elements(df, name, None if widths is None else widths[name])]
        else:
            require_numeric(df, [name])
            found = [clean_double(df, name)]
        values += found
        names += [name] * len(found)
    if handle_invalid == "skip":
        return values, balanced(Column.__and__, [value.isNotNull() for value in values])
    if handle_invalid == "keep":
        return [F.coalesce(value, F.lit(float("nan"))) for value in values], None
    if handle_invalid == "error":
        text = "column {} holds a null or NaN; set handle_invalid to skip or keep"
        stops = [F.raise_error(F.lit(text.format(name))).cast("double") for name in names]
        return [F.coalesce(value, stop) for value, stop in zip(values, stops)], None
    raise ValueError(f"handle_invalid is error, skip or keep, not {handle_invalid!r}")


def _fit_stage(df: DataFrame, columns: Sequence[str | int], stage, handle_invalid: str):
    """Fit a Spark ML vector stage on the assembled columns."""
    names = resolve_all(df, columns)
    narrow = df.select(*[quoted(name) for name in dict.fromkeys(names)])
    vector = free_name(narrow, "features")
    return stage.setInputCol(vector).fit(assemble(narrow, names, vector, handle_invalid))


def fit_quantile_bins(
    df: DataFrame,
    column: str | int,
    new_column: str | None = None,
    num_buckets: int = 5,
    *,
    relative_error: float = 0.01,
    handle_invalid: str = "error",
) -> FittedStage:
    """Bins of about equal size; with relative_error 0 the splits are exact at any table size."""
    name = resolve(df, column)
    require_numeric(df, [name])
    output = new_column or name + QUANTILE_SUFFIX
    if relative_error > 0:
        discretizer = QuantileDiscretizer(
            numBuckets=num_buckets,
            inputCol=name,
            outputCol=output,
            relativeError=relative_error,
            handleInvalid=handle_invalid,
        )
        return FittedStage(discretizer.fit(df.select(quoted(name))))
    shares = [i / num_buckets for i in range(1, num_buckets)]
    with held(df.select(quoted(name))) as values:
        found, _ = exact_quantiles(values, {name: shares}, method="disc")
    inner = sorted({value for value in found[name] if value is not None})
    splits = [float("-inf"), *inner, float("inf")]
    if len(splits) < 3:
        splits.insert(1, 0.0)
    return FittedStage(
        Bucketizer(splits=splits, inputCol=name, outputCol=output, handleInvalid=handle_invalid)
    )


def quantile_bins(df: DataFrame, column: str | int, new_column: str | None = None, num_buckets: int = 5,
                  **options) -> DataFrame:
    return fit_quantile_bins(df, column, new_column, num_buckets, **options).transform(df)


def fit_vector_index(
    df: DataFrame,
    columns: Sequence[str | int],
    new_column: str | None = None,
    max_categories: int = 20,
    handle_invalid: str = "error",
) -> FittedFeature:
    """Columns with few distinct values become category indices (0.0 always 0), others stay."""
    names = resolve_all(df, columns)
    output = new_column or "_".join(names) + VECTOR_INDEX_SUFFIX
    fitted = _fit_stage(df, names, VectorIndexer(maxCategories=max_categories), handle_invalid)
    categories = {str(i): sorted((float(value), float(index)) for value, index in found.items()) for i, found in fitted.categoryMaps.items()}
    return _built(df.sparkSession, _state(df, "vector_index", output, names, handle_invalid, categories=categories), fitted)


def _indexed(inputs: Sequence[Column], categories: Mapping[str, Sequence]) -> Column:
    return _floats([_category_index(value, dict(map(tuple, categories[str(i)]))) if str(i) in categories else value for i, value in enumerate(inputs)])


def _category_index(value: Column, categories: Mapping[float, int]) -> Column:
    """The category's index; a value that was not there when fitting is an error."""
    known = sorted((float(category), float(i)) for category, i in categories.items())
    table = F.map_from_arrays(F.lit([category for category, _ in known]), F.lit([i for _, i in known]))
    index = F.try_element_at(table, value + F.lit(0.0))  # a zero has no sign
    unseen = F.raise_error(F.lit("a value was not among the categories when fitting"))
    return F.coalesce(index, F.when(~F.isnan(value), unseen.cast("double")).otherwise(value))


def vector_index(df: DataFrame, columns: Sequence[str | int], new_column: str | None = None,
                 max_categories: int = 20, handle_invalid: str = "error") -> DataFrame:
    return fit_vector_index(df, columns, new_column, max_categories, handle_invalid).transform(df)


def fit_standard_scale(
    df: DataFrame,
    columns: Sequence[str | int],
    new_column: str | None = None,
    *,
    with_mean: bool = False,
    with_std: bool = True,
    handle_invalid: str = "error",
) -> FittedFeature:
    """Divide by the sample standard deviation; centre only on request. A constant becomes 0."""
    names = resolve_all(df, columns)
    output = new_column or "_".join(names) + SCALE_SUFFIX
    fitted = _fit_stage(df, names, StandardScaler(withMean=with_mean, withStd=with_std), handle_invalid)
    means = [float(mean) for mean in fitted.mean] if with_mean else None
    factors = [1.0 / float(std) if std else 0.0 for std in fitted.std] if with_std else None
    return _built(df.sparkSession, _state(df, "standard_scale", output, names, handle_invalid, means=means, factors=factors), fitted)


def _scaled(inputs: Sequence[Column], means: Sequence[float] | None, factors: Sequence[float] | None) -> Column:
    values = list(inputs)
    if means is not None:
        values = [value - F.lit(mean) for value, mean in zip(values, means)]
    if factors is not None:
        values = [value * F.lit(factor) for value, factor in zip(values, factors)]
    return _floats(values)


def standard_scale(df: DataFrame, columns: Sequence[str | int], new_column: str | None = None,
                   **options) -> DataFrame:
    return fit_standard_scale(df, columns, new_column, **options).transform(df)


def fit_pca(
    df: DataFrame,
    columns: Sequence[str | int],
    new_column: str | None = None,
    k: int = 3,
    handle_invalid: str = "error",
) -> FittedFeature:
    """Projection onto the first k principal components, without centring; signs are arbitrary."""
    names = resolve_all(df, columns)
    state = _state(df, "pca", new_column or PCA_NAME, names, handle_invalid)
    size = len(state.inputs(df.sparkSession)[0])
    if k >= size:
        raise ValueError(f"k = {k} must be less than the number of columns, {size}")
    fitted = _fit_stage(df, names, PCA(k=k), handle_invalid)
    components = [[float(w) for w in weights] for weights in fitted.pc.toArray().T]
    return _built(df.sparkSession, replace(state, numbers={"components": components}), fitted)


def _projected(inputs: Sequence[Column], components: Sequence[Sequence[float]]) -> Column:
    return _floats([balanced(Column.__add__, [value * F.lit(w) for value, w in zip(inputs, weights)]) for weights in components])


def pca(df: DataFrame, columns: Sequence[str | int], new_column: str | None = None, k: int = 3,
        handle_invalid: str = "error") -> DataFrame:
    return fit_pca(df, columns, new_column, k, handle_invalid).transform(df)


def pca_variance(df: DataFrame, columns: Sequence[str | int], k: int = 3) -> DataFrame:
    """Share of the variance that each of the first k components explains."""
    shares = fit_pca(df, columns, k=k).model.explainedVariance.toArray()
    rows = [(i, float(share)) for i, share in enumerate(shares)]
    return df.sparkSession.createDataFrame(rows, "component int, explained_variance double")


def fit_polynomial(
    df: DataFrame,
    columns: Sequence[str | int],
    new_column: str | None = None,
    degree: int = 2,
    handle_invalid: str = "error",
) -> FittedFeature:
    """Products of the columns up to a degree; nothing is learned but the columns' widths."""
    names = resolve_all(df, columns)
    output = new_column or "_".join(names) + POLYNOMIAL_SUFFIX
    return _built(df.sparkSession, _state(df, "polynomial", output, names, handle_invalid, degree=degree))


def polynomial(
    df: DataFrame,
    columns: Sequence[str | int],
    new_column: str | None = None,
    degree: int = 2,
    handle_invalid: str = "error",
) -> DataFrame:
    """Products of the columns up to a degree: (x, y) gives (x, x*x, y, x*y, y*y)."""
    return fit_polynomial(df, columns, new_column, degree, handle_invalid).transform(df)


def _products(inputs: Sequence[Column], degree: int) -> Column:
    found = _powers(len(inputs), degree)
    return _floats([reduce(Column.__mul__, [inputs[i] for i, power in enumerate(powers) for _ in range(power)]) for powers in found])


def _powers(n: int, degree: int) -> list[tuple[int, ...]]:
    """Exponents of all terms, in the order in which each column adds its terms to those before."""
    if n == 0:
        return []
    picks = combinations_with_replacement(range(n + 1), degree)
    found = {tuple(pick.count(i) for i in range(n)) for pick in picks}
    return sorted((powers for powers in found if any(powers)), key=lambda powers: powers[::-1])


def fit_one_hot(
    df: DataFrame,
    columns: Sequence[str | int],
    new_columns: Sequence[str] | None = None,
    *,
    drop_last: bool = True,
    as_array: bool = False,
) -> FittedFeature | FittedStage:
    """Unit vectors of non-negative integers; the last category is all zeros.

    The vectors are sparse. `as_array` writes out every zero, for columns with few categories.
    """
    names = resolve_all(df, columns)
    require_numeric(df, names)
    outputs = list(new_columns or [name + ONE_HOT_SUFFIX for name in names])
    if len(outputs) != len(names):
        raise ValueError("one-hot needs one new name per column")
    encoder = OneHotEncoder(inputCols=names, outputCols=outputs, dropLast=drop_last)
    fitted = encoder.fit(df.select(*[quoted(name) for name in dict.fromkeys(names)]))
    if not as_array:
        return FittedStage(fitted)
    if max(fitted.categorySizes) > ONE_HOT_WIDTH:
        raise ValueError(f"a one-hot array would have {max(fitted.categorySizes)} places, more than {ONE_HOT_WIDTH}; index the column first")
    sizes = dict(zip(outputs, map(int, fitted.categorySizes)))
    schema = T.StructType([df.schema[name] for name in dict.fromkeys(names)]).jsonValue()
    state = State("one_hot", "", names, schema, {}, "error", {"outputs": outputs, "sizes": sizes, "drop_last": drop_last})
    return FittedFeature(_units(names, **state.numbers), fitted, None, state)


def _units(names: Sequence[str], outputs: Sequence[str], sizes: Mapping[str, int], drop_last: bool) -> dict[str, Column]:
    columns = {}
    for name, output in zip(names, outputs):
        size, value = sizes[output], quoted(name).cast("int")
        unseen = F.raise_error(F.lit(f"a value of {name} was not among the categories when fitting")).cast("int")
        value = F.when((value >= 0) & (value < size), value).otherwise(unseen)
        length = size - 1 if drop_last else size
        places = F.sequence(F.lit(0), F.lit(length - 1)) if length else F.array().cast("array<int>")
        columns[output] = F.transform(places, _unit(value))
    return columns


def _unit(value: Column) -> Callable[[Column], Column]:
    return lambda place: (place == value).cast("float")


def one_hot(df: DataFrame, columns: Sequence[str | int], new_columns: Sequence[str] | None = None,
            **options) -> DataFrame:
    return fit_one_hot(df, columns, new_columns, **options).transform(df)


def fit_chi_square(
    df: DataFrame,
    columns: Sequence[str | int],
    label: str | int,
    new_column: str | None = None,
    num_top_features: int = 1,
    handle_invalid: str = "error",
) -> FittedFeature:
    """Keep the columns that depend most on the label by the chi-square test."""
    names, target = _chi_square_columns(df, columns, label)
    output = new_column or CHI_SQUARE_NAME.format(target, num_top_features)
    state = _state(df, "chosen", output, names, handle_invalid)
    inputs, present = state.inputs(df.sparkSession)
    tests = _chi_square_tests(df if present is None else df.where(present), inputs, target)
    order = sorted(range(len(tests)), key=lambda i: (tests[i].p_value, i))
    chosen = sorted(order[: int(num_top_features)])
    return _built(df.sparkSession, replace(state, numbers={"places": chosen}))


def _chosen(inputs: Sequence[Column], places: Sequence[int]) -> Column:
    return _floats([inputs[i] for i in places])


def chi_square(df: DataFrame, columns: Sequence[str | int], label: str | int,
               new_column: str | None = None, num_top_features: int = 1,
               handle_invalid: str = "error") -> DataFrame:
    fitted = fit_chi_square(df, columns, label, new_column, num_top_features, handle_invalid)
    return fitted.transform(df)


def chi_square_scores(df: DataFrame, columns: Sequence[str | int], label: str | int) -> DataFrame:
    """The test behind the selection: statistic, degrees of freedom and p-value per column."""
    names, target = _chi_square_columns(df, columns, label)
    inputs, _ = _inputs(df, names, "error")
    named = [name for name in names for _ in range(width(df, name) if is_vector(df, name) else 1)]
    rows = [(name, t.statistic, t.degrees, t.p_value) for name, t in zip(named, _chi_square_tests(df, inputs, target))]
    return df.sparkSession.createDataFrame(rows, "column string, statistic double, degrees_of_freedom long, p_value double")


class _Test(NamedTuple):
    statistic: float
    degrees: int
    p_value: float


def _chi_square_tests(df: DataFrame, inputs: Sequence[Column], target: str) -> list[_Test]:
    """Pearson's test of each input against the label, from a contingency table that stays distributed.

    Cells are counted by input, value and label, so any number of distinct values and labels will do. Each cell meets
    its row's and column's totals by joins; only one row for each input comes back.
    """
    label = F.coalesce(quoted(target).cast("double"), F.raise_error(F.lit(f"column {target} holds a null")).cast("double"))
    points = F.array(*[F.struct(F.lit(i).alias("input"), value.alias("value")) for i, value in enumerate(inputs)])
    cells = df.select(label.alias("label"), F.inline(points)).groupBy("input", "value", "label").agg(F.count("*").cast("double").alias("n"))
    with held(cells) as counted:
        by_value = counted.groupBy("input", "value").agg(F.sum("n").alias("of_value"))
        by_label = counted.groupBy("input", "label").agg(F.sum("n").alias("of_label"))
        totals = by_value.groupBy("input").agg(F.sum("of_value").alias("rows"), F.count("*").alias("values"))
        labels = by_label.groupBy("input").agg(F.count("*").alias("labels"))
        expected = F.col("of_value") * F.col("of_label") / F.col("rows")
        met = counted.join(by_value, ["input", "value"]).join(by_label, ["input", "label"]).join(F.broadcast(totals), "input")
        # Empty cells add their expected counts, which are what the filled cells leave of all rows.
        parts = met.select("input", "rows", ((F.col("n") - expected) * (F.col("n") - expected) / expected - expected).alias("part"))
        sums = parts.groupBy("input").agg((F.max("rows") + F.sum("part")).alias("statistic"))
        found = sums.join(totals, "input").join(labels, "input").orderBy("input").collect()  # one row for each input
    tests = []
    for row in found:
        degrees = (row["values"] - 1) * (row["labels"] - 1)
        statistic = max(float(row["statistic"]), 0.0) if degrees else 0.0
        tests.append(_Test(statistic, degrees, chi_square_tail(statistic, degrees) if degrees else 1.0))
    return tests


def _chi_square_columns(
    df: DataFrame, columns: Sequence[str | int], label: str | int
) -> tuple[list[str], str]:
    names = resolve_all(df, columns)
    target = resolve(df, label)
    if len(names) < 2:
        raise ValueError("a chi-square selection needs at least two columns")
    require_numeric(df, [*names, target])
    return names, target


def string_index(
    df: DataFrame,
    column: str | int,
    new_column: str | None = None,
    *,
    handle_invalid: str = "error",
    label_limit: int = LABEL_LIMIT,
) -> DataFrame:
    """Index of each value by frequency: 0.0 is the most frequent, ties in value order.

    Up to `label_limit` distinct values are kept in a model; more are ranked and joined as a
    table, which gives the same indices.
    """
    name = resolve(df, column)
    output = new_column or name + STRING_INDEX_SUFFIX
    counted = _label_counts(df, name)
    labels = _few_labels(counted, label_limit)
    if labels is not None:
        return _string_index_model(labels, name, output, handle_invalid).transform(df)
    return _label_table(counted, name, output, handle_invalid).transform(df)


def fit_string_index(
    df: DataFrame,
    column: str | int,
    new_column: str | None = None,
    *,
    handle_invalid: str = "error",
    label_limit: int = LABEL_LIMIT,
) -> FittedStage | FittedStringIndex:
    """A reusable string index: a model for up to `label_limit` values, a label table in shared storage for more."""
    name = resolve(df, column)
    output = new_column or name + STRING_INDEX_SUFFIX
    counted = _label_counts(df, name)
    labels = _few_labels(counted, label_limit)
    if labels is not None:
        return FittedStage(_string_index_model(labels, name, output, handle_invalid))
    return _label_table(counted, name, output, handle_invalid)


def _label_table(counted: DataFrame, name: str, output: str, handle_invalid: str) -> FittedStringIndex:
    """Labels ranked by falling count over range partitions and written below the scratch folder."""
    spark = counted.sparkSession
    ranked, position = with_position(counted, [F.col("rows").desc(), F.col("label")])
    path = scratch_path(spark, "labels")
    ranked.select("label", "rows", F.col(position).cast("double").alias("index")).write.parquet(path)
    labels = spark.read.parquet(path)
    size = labels.agg(F.sum("rows").alias("rows"), F.count("*").alias("labels")).head()
    return FittedStringIndex(labels, size["rows"] or 0, size["labels"], name, output, handle_invalid)


def _label_counts(df: DataFrame, name: str) -> DataFrame:
    text = quoted(name).cast("string")
    present = df.where(text.isNotNull()).groupBy(text.alias("label"))
    return present.agg(F.count("*").alias("rows"))


def _few_labels(counted: DataFrame, limit: int) -> list[str] | None:
    """All labels in index order, or None if there are more than the limit."""
    found = counted.limit(limit + 1).collect()
    if len(found) > limit:
        return None
    # Unsigned bytes order, as Spark compares strings.
    return [r["label"] for r in sorted(found, key=lambda r: (-r["rows"], r["label"].encode()))]


def _string_index_model(
    labels: list[str], name: str, output: str, handle_invalid: str
) -> StringIndexerModel:
    return StringIndexerModel.from_labels(
        labels, inputCol=name, outputCol=output, handleInvalid=handle_invalid
    )


def _join_labels(df: DataFrame, index: FittedStringIndex) -> DataFrame:
    """Join the ranked label table.

    Rows of frequent labels meet them by broadcast, and nulls meet nothing: neither are shuffled. Only rows of
    labels that each had less than HOT_SHARE of the rows are dealt out by label, so that no task gets a hot key. The same
    goes for labels that were not there when fitting, unless one of them is hot in the table now: that join is left to
    adaptive splitting. The table is read once for either kind.
    """
    name, output = resolve(df, index.column), index.output
    hot = index.labels.where(F.col("rows") > index.rows * HOT_SHARE)
    rare = index.labels.where(F.col("rows") <= index.rows * HOT_SHARE)
    text = quoted(name).cast("string")
    label, index_column = (free_name(df, stem) for stem in ("label", "hot_index"))
    known = [F.col("label").alias(label), F.col("index").alias(index_column)]
    marked = df.withColumn(label, text)
    met = marked.join(F.broadcast(hot.select(*known)), label, "left")
    done = met.where(quoted(index_column).isNotNull() | quoted(label).isNull())
    others = met.where(quoted(index_column).isNull() & quoted(label).isNotNull()).drop(index_column)
    joined = done.unionByName(others.join(rare.select(*known), label, "left"))
    place = quoted(index_column)
    kept = [quoted(c) for c in df.columns]
    if index.handle_invalid == "keep":
        place = F.coalesce(place, F.lit(float(index.size)))
    elif index.handle_invalid == "skip":
        joined = joined.where(place.isNotNull())
    else:
        missing = F.raise_error(F.lit(f"column {name} holds a null or a label unknown when fitting; set handle_invalid to skip or keep"))
        place = F.coalesce(place, missing.cast("double"))
    return joined.select(*kept, place.alias(output))


_KINDS: dict[str, Callable[..., Column]] = {
    "vector_index": _indexed,
    "standard_scale": _scaled,
    "pca": _projected,
    "polynomial": _products,
    "chosen": _chosen,
}
