"""Training, saving and inspecting classifiers."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import pairwise

from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    LinearSVC,
    LinearSVCModel,
    LogisticRegression,
    LogisticRegressionModel,
    LogisticRegressionSummary,
    MultilayerPerceptronClassificationModel,
    MultilayerPerceptronClassifier,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tablewright.functions.columns import (
    as_double,
    balanced,
    data_type,
    elements,
    is_numeric,
    is_vector,
    lenient_double,
    quoted,
    resolve,
    resolve_all,
)
from tablewright.sources.layout import held, spread
from tablewright.sources.scratch import has_scratch, scratch_path

FEATURES, LABEL, INDEXED, WEIGHT = "features", "label", "indexed", "weight"


# A forest's label has at most so many classes; each leaf counts all of them.
MAX_CLASSES = 1_000

# Boosted trees are trained on groups of rows with equal bins from so many rows on, if a group stands for so many on average.
GROUPED_FROM, LEAST_GROUP = 100_000, 4

# On so many rows, or the square of the bins, Spark's tree trainers find the thresholds between bins.
BIN_ROWS = 10_000


def _tree_row_bytes(rows: DataFrame, trees: int, boosted: bool = False) -> int:
    """What a row takes in Spark's tree trainers: objects, the features, a count per tree, and when boosting its error."""
    features = rows.schema[FEATURES].metadata["ml_attr"]["num_attrs"]
    return 130 + 8 * features + 4 * trees + (110 if boosted else 0)


@dataclass
class SgdSvmModel:
    """A linear margin without intercept; above the threshold the prediction is 1."""

    weights: list[float]
    threshold: float = 0.0

    def margin(self, inputs: Sequence[Column]) -> Column:
        if len(inputs) != len(self.weights):
            raise ValueError(f"the model has {len(self.weights)} inputs, the table gives {len(inputs)}")
        return balanced(Column.__add__, [x * F.lit(w) for x, w in zip(inputs, self.weights)])


@dataclass
class TrainedModel:
    """A fitted classifier with the columns it was trained on.

    `classes` holds the label values in index order where the classifier was trained on indexed
    labels, so predictions can be mapped back.
    """

    kind: str
    model: object
    features: list[str]
    label: str
    classes: list[str] | None = None

    def save(self, path: str, overwrite: bool = True) -> str:
        return save_model(self, path, overwrite=overwrite)


_LOADERS = {
    "svm": LinearSVCModel,
    "gbt": GBTClassificationModel,
    "lr": LogisticRegressionModel,
    "lr_multi": LogisticRegressionModel,
    "mlp": MultilayerPerceptronClassificationModel,
    "forest": RandomForestClassificationModel,
}


# --- preparing rows ---------------------------------------------------------------------------


def input_columns(
    df: DataFrame, features: Sequence[str | int], *, lenient: bool = False
) -> list[Column]:
    """Feature columns as doubles, vectors and arrays element by element.

    Text must spell numbers unless lenient, then it counts as 0.0; columns of other types raise.
    """
    found: list[Column] = []
    for name in resolve_all(df, features):
        if is_vector(df, name):
            found += elements(df, name)
        elif isinstance(data_type(df, name), (T.ArrayType, T.MapType, T.StructType, T.BinaryType)):
            raise ValueError(f"column {name!r} can't be a feature, it is {data_type(df, name).simpleString()}")
        else:
            found.append(lenient_double(df, name) if lenient else as_double(df, name))
    return found


def lenient_features(
    df: DataFrame, features: Sequence[str | int], label: str | int | None = None
) -> DataFrame:
    """The chosen columns as doubles with 0.0 wherever they hold no number."""
    names = resolve_all(df, [*features, *([] if label is None else [label])])
    return df.select(*[lenient_double(df, name).alias(name) for name in names])


def points(
    df: DataFrame,
    features: Sequence[str | int],
    label: str | int | None = None,
    *,
    label_text: bool = False,
    lenient: bool = False,
    handle_invalid: str = "error",
) -> DataFrame:
    """The feature vector, and the label if one is named; all other columns are dropped."""
    inputs = [c.alias(f"x{i}") for i, c in enumerate(input_columns(df, features, lenient=lenient))]
    if label is not None:
        name = resolve(df, label)
        if label_text:
            value = quoted(name)
            if not is_numeric(df, name):
                value = value.cast("string")
            elif not isinstance(data_type(df, name), T.IntegralType):
                value = value.cast("double")
        else:
            value = lenient_double(df, name) if lenient else as_double(df, name)
        inputs.append(value.alias(LABEL))
    names = [f"x{i}" for i in range(len(inputs) - (label is not None))]
    assembler = VectorAssembler(inputCols=names, outputCol=FEATURES, handleInvalid=handle_invalid)
    return assembler.transform(df.select(*inputs)).drop(*names)


def _number(value: object, kind: type) -> object:
    return kind(value) if isinstance(value, str) else value


def _flag(value: object) -> bool:
    return value.strip().lower() != "false" if isinstance(value, str) else bool(value)


# --- trainers ---------------------------------------------------------------------------------


def train_svm(
    df: DataFrame,
    label: str | int,
    features: Sequence[str | int],
    *,
    iterations: int = 100,
    step: float = 1.0,
    reg_param: float = 0.01,
    reg_type: str | None = "l2",
    convergence_tol: float = 0.001,
    engine: str = "sgd",
    keep: str = "last",
) -> TrainedModel:
    """Linear support vector machine for a 0/1 label, without intercept.

    `sgd` runs full-batch subgradient descent with the given step and penalty (l2, l1 or none). Its steps can overshoot
    and turn the margin round: `keep="best"` returns the weights with the least loss and penalty among all that the steps
    came to, for one more pass; `last` returns those of the last step, as Spark's SVMWithSGD does.
    `owlqn` is Spark's LinearSVC, which has an l2 penalty only and chooses its own steps.
    """
    iterations, step = _number(iterations, int), _number(step, float)
    reg_param, convergence_tol = _number(reg_param, float), _number(convergence_tol, float)
    names, target = resolve_all(df, features), resolve(df, label)
    if keep not in ("last", "best"):
        raise ValueError(f"keep must be 'last' or 'best', not {keep!r}")
    if engine == "sgd":
        model = _descend(df, target, names, iterations, step, reg_param, reg_type, convergence_tol, keep == "best")
    elif engine == "owlqn":
        if reg_type != "l2":
            raise ValueError("the owlqn engine has an l2 penalty only")
        estimator = LinearSVC(
            maxIter=iterations,
            regParam=reg_param,
            tol=convergence_tol,
            fitIntercept=False,
            standardization=False,
        )
        with held(points(df, names, target)) as rows:
            model = estimator.fit(rows)
    else:
        raise ValueError(f"unknown engine {engine!r}")
    return TrainedModel("svm", model, names, target)


def _descend(
    df: DataFrame,
    label: str,
    features: list[str],
    iterations: int,
    step: float,
    reg_param: float,
    reg_type: str | None,
    tolerance: float,
    keep_best: bool,
) -> SgdSvmModel:
    """Hinge-loss subgradient descent; each iteration is one aggregate of as many sums as features, and of the loss.

    The weights are one array constant that the generated code refers to, and no numbers written into it: the code of
    the first iteration serves all others.
    """
    if reg_type not in ("l1", "l2", "none", None):
        raise ValueError(f"unknown penalty {reg_type!r}")
    values = input_columns(df, features)
    inputs = [F.col(f"x{i}") for i in range(len(values))]
    chosen = df.select(*[x.alias(f"x{i}") for i, x in enumerate(values)], as_double(df, label).alias("y"))
    with held(chosen) as rows:
        bad = F.col("y").isNull() | ~F.col("y").isin(0.0, 1.0) | balanced(Column.__or__, [x.isNull() for x in inputs])
        checked = rows.agg(F.count("*").alias("n"), F.count(F.when(bad, F.lit(1))).alias("bad")).head()
        if not checked["n"] or checked["bad"]:
            raise ValueError(f"{checked['bad']} of {checked['n']} rows have nulls or a label other than 0 and 1")
        weights = best = [0.0] * len(inputs)
        least, still = math.inf, False
        for turn in range(1, iterations + 2):
            if not keep_best and (still or turn > iterations):
                return SgdSvmModel(weights)
            *sums, lost = _pulls(rows, inputs, weights).head()
            if turn > 1:
                cost = lost / checked["n"] + _penalty(weights, reg_param, reg_type)
                if cost <= least:
                    best, least = weights, cost
            if still or turn > iterations:
                break
            before = weights
            weights = _updated(before, [s / checked["n"] for s in sums], step / math.sqrt(turn), reg_param, reg_type)
            still = turn > 1 and math.dist(before, weights) < tolerance * max(math.hypot(*weights), 1.0)
        return SgdSvmModel(best)


def _penalty(weights: Sequence[float], reg_param: float, reg_type: str | None) -> float:
    if reg_type == "l2":
        return reg_param / 2 * sum(w * w for w in weights)
    return reg_param * sum(abs(w) for w in weights) if reg_type == "l1" else 0.0


def _pulls(rows: DataFrame, inputs: Sequence[Column], weights: Sequence[float]) -> DataFrame:
    """The subgradient's sums over all rows on the wrong side of the margin, and last their loss."""
    # The place depends on the row, where it is always the same, or the optimizer would write the number itself into the code.
    current, none = F.lit(list(weights)), F.col("y").isNull().cast("int")
    side = 2 * F.col("y") - 1
    margin = balanced(Column.__add__, [x * F.get(current, none + i) for i, x in enumerate(inputs)])
    pulled = rows.select(*inputs, F.when(side * margin < 1, -side).otherwise(0.0).alias("pull"), (side * margin).alias("reach"))
    lost = F.sum(F.greatest(1 - F.col("reach"), F.lit(0.0)))
    return pulled.agg(*[F.sum(F.col("pull") * x) for x in inputs], lost)


def _updated(
    weights: list[float], gradient: list[float], rate: float, reg_param: float, reg_type: str | None
) -> list[float]:
    if reg_type == "l2":
        weights = [w * (1 - rate * reg_param) for w in weights]
    moved = [w - rate * g for w, g in zip(weights, gradient)]
    if reg_type == "l1":
        moved = [math.copysign(max(0.0, abs(w) - reg_param * rate), w) for w in moved]
    return moved


def train_gbt(
    df: DataFrame,
    label: str | int,
    features: Sequence[str | int],
    *,
    iterations: int = 20,
    step: float = 0.1,
    max_depth: int = 5,
    min_instances_per_node: int = 1,
    seed: int | None = None,
) -> TrainedModel:
    """Gradient-boosted trees for two classes of any type, indexed by frequency.

    The trainer passes over its rows some six times a tree and sees of a row only its class and the bins its features fall
    into. Where the bins leave room for far fewer different rows than the table has, the rows are counted by bins and class
    once, and the trainer gets the groups, weighted by their rows: the same trees, but for the last digits of their sums.
    """
    names, target = resolve_all(df, features), resolve(df, label)
    rows, indexer, classes, count = _indexed_points(df, names, target, 2)
    if len(classes) != 2:
        raise ValueError(f"the label must have two classes, it has {len(classes)}")
    estimator = GBTClassifier(
        labelCol=INDEXED,
        maxIter=_number(iterations, int),
        stepSize=_number(step, float),
        maxDepth=_number(max_depth, int),
        minInstancesPerNode=_number(min_instances_per_node, int),
        seed=_number(seed, int),
    )
    cuts = _bin_cuts(df, names, rows, count, estimator)
    if cuts is not None:
        return TrainedModel("gbt", _fit_groups(estimator, indexer.transform(rows), cuts, count), names, target, classes)
    with held(rows, _tree_row_bytes(rows, 1, boosted=True)) as kept:
        return TrainedModel("gbt", estimator.fit(indexer.transform(kept)), names, target, classes)


def _bin_cuts(
    df: DataFrame, names: list[str], rows: DataFrame, count: int, estimator: GBTClassifier
) -> list[list[float]] | None:
    """The thresholds between each feature's bins, or nothing if grouping rows by bins would not pay or not give the same trees.

    They come from as many rows as in Spark's trainer. The groups are counted by the bins alone, not by what the table holds.
    """
    most, known = count // (2 * LEAST_GROUP), rows.schema[FEATURES].metadata["ml_attr"]
    if count < GROUPED_FROM or known["num_attrs"] >= most.bit_length() or not has_scratch(df.sparkSession):
        return None
    if {"nominal", "binary"} & set(known.get("attrs", {})) or _least_share(estimator, count) >= 0.5:
        return None
    bins = min(estimator.getMaxBins(), count)
    share = max(bins * bins, BIN_ROWS) / count
    taken = points(df.sample(share, estimator.getSeed()) if share < 1 else df, names)
    sample = taken.select(vector_to_array(FEATURES)).collect()
    cuts = [_cuts_between(Counter(values), bins) for values in zip(*[r[0] for r in sample])]
    return cuts if cuts and math.prod(len(cut) + 1 for cut in cuts) <= most else None


def _cuts_between(values: Counter[float], bins: int) -> list[float]:
    """Thresholds by the rule of Spark's trees: between all values, or where they come closest to equal shares of the rows."""
    found = sorted(values.items())
    middles = [(a + b) / 2 for (a, _), (b, _) in pairwise(found)]
    if len(middles) >= bins:
        stride = goal = values.total() / bins
        reached, every, middles = 0, middles, []
        for middle, (_, n), (_, following) in zip(every, found, found[1:]):
            reached += n
            if abs(reached - goal) < abs(reached + following - goal):
                middles.append(middle)
                goal += stride
    return sorted({m for m in middles if m < math.inf})


def _least_share(estimator: GBTClassifier, count: int) -> float:
    """The share of all weight that a node's rows have at least, in place of their number; weights are whole numbers."""
    least = estimator.getMinInstancesPerNode()
    return (least - 0.5) / count if least > 1 else 0.0


def _fit_groups(estimator: GBTClassifier, rows: DataFrame, cuts: list[list[float]], count: int) -> GBTClassificationModel:
    """The model of all rows, from one weighted row for each class and combination of bins."""
    path = scratch_path(rows.sparkSession, "gbt")
    names = [f"b{i}" for i in range(len(cuts))]
    values = rows.select(vector_to_array(FEATURES).alias("v"), INDEXED)
    values = values.select(*[_finite(F.get("v", F.lit(i))).alias(n) for i, n in enumerate(names)], INDEXED)
    bins = [
        balanced(Column.__add__, [(F.col(n) > t).cast("double") for t in cut]) if cut else F.col(n) * 0
        for n, cut in zip(names, cuts)
    ]
    counted = values.select(*[b.alias(n) for b, n in zip(bins, names)], INDEXED).groupBy(*names, INDEXED)
    groups = VectorAssembler(inputCols=names, outputCol=FEATURES).transform(
        counted.agg(F.count("*").cast("double").alias(WEIGHT))
    ).drop(*names)
    # With this many bins allowed the trainer looks at all groups for the values a bin number takes.
    wide = max(estimator.getMaxBins(), math.isqrt(2 * math.prod(len(cut) + 1 for cut in cuts)) + 1)
    settings = {
        estimator.weightCol: WEIGHT,
        estimator.maxBins: wide,
        estimator.minInstancesPerNode: 1,
        estimator.minWeightFractionPerNode: _least_share(estimator, count),
    }
    with held(groups, _tree_row_bytes(groups, 1, boosted=True)) as kept:
        model = estimator.fit(kept, settings)
    model.write().save(f"{path}/bins")
    moved = _with_cuts(rows.sparkSession, f"{path}/bins", f"{path}/model", cuts)
    for param in settings:
        moved.clear(moved.getParam(param.name))
        if estimator.isSet(param):
            moved.set(moved.getParam(param.name), estimator.getOrDefault(param))
    return moved


def _finite(value: Column) -> Column:
    """The number, or the error that Spark's trainers make of an infinite one."""
    wrong = F.raise_error(F.concat(F.lit("Vector values MUST NOT be NaN or Infinity, but got "), value.cast("string")))
    return F.when(F.abs(value) < math.inf, value).otherwise(wrong.cast("double"))


def _with_cuts(spark: SparkSession, source: str, target: str, cuts: list[list[float]]) -> GBTClassificationModel:
    """A saved model over numbers of bins as one over the features, saved beside it: thresholds, and rows for groups."""
    thresholds = F.array(*[F.lit(cut).cast("array<double>") for cut in cuts])
    node = F.col("nodeData")
    own = F.get(thresholds, node["split"]["featureIndex"])
    moved = F.transform(node["split"]["leftCategoriesOrThreshold"], lambda at: F.get(own, F.floor(at).cast("int")))
    nodes = node.withField("split.leftCategoriesOrThreshold", moved).withField("rawCount", node["impurityStats"][0].cast("long"))
    spark.read.parquet(f"{source}/data").withColumn("nodeData", nodes).write.parquet(f"{target}/data")
    spark.read.parquet(f"{source}/treesMetadata").write.parquet(f"{target}/treesMetadata")
    spark.read.text(f"{source}/metadata").write.text(f"{target}/metadata")
    return GBTClassificationModel.load(target)


def _indexed_points(
    df: DataFrame, names: list[str], target: str, limit: int
) -> tuple[DataFrame, StringIndexerModel, list[str], int]:
    """The points, what indexes their label, and their number; more classes than the limit are an error before any are gathered."""
    rows = points(df, names, target, label_text=True)
    labels = rows.select(LABEL)
    classes, count = labels.groupBy(LABEL).count().agg(F.count("*"), F.sum("count")).head()
    if classes > limit:
        raise ValueError(f"column {target!r} has more than {limit} classes")
    indexer = StringIndexer(inputCol=LABEL, outputCol=INDEXED).fit(labels)
    return rows, indexer, list(indexer.labels), count or 0


def train_lr(
    df: DataFrame,
    label: str | int,
    features: Sequence[str | int],
    *,
    iterations: int = 100,
    reg_param: float = 0.0,
    elastic_net_param: float = 0.0,
    tol: float = 1e-6,
    fit_intercept: bool | str = True,
    threshold: float = 0.5,
    lenient: bool = False,
) -> TrainedModel:
    """Binary logistic regression for a numeric 0/1 label."""
    estimator = LogisticRegression(
        maxIter=_number(iterations, int),
        regParam=_number(reg_param, float),
        elasticNetParam=_number(elastic_net_param, float),
        tol=_number(tol, float),
        fitIntercept=_flag(fit_intercept),
        threshold=_number(threshold, float),
        standardization=True,
        aggregationDepth=2,
        family="auto",
    )
    names, target = resolve_all(df, features), resolve(df, label)
    with held(points(df, names, target, lenient=lenient)) as rows:
        return TrainedModel("lr", estimator.fit(rows), names, target)


def train_lr_multi(
    df: DataFrame,
    label: str | int,
    features: Sequence[str | int],
    *,
    iterations: int = 100,
    reg_param: float = 0.0,
    elastic_net_param: float = 0.0,
    tol: float = 1e-6,
    fit_intercept: bool | str = True,
    lenient: bool = False,
) -> TrainedModel:
    """Multinomial logistic regression for labels 0 .. k-1."""
    estimator = LogisticRegression(
        maxIter=_number(iterations, int),
        regParam=_number(reg_param, float),
        elasticNetParam=_number(elastic_net_param, float),
        tol=_number(tol, float),
        fitIntercept=_flag(fit_intercept),
        standardization=True,
        aggregationDepth=2,
        family="multinomial",
    )
    names, target = resolve_all(df, features), resolve(df, label)
    with held(points(df, names, target, lenient=lenient)) as rows:
        return TrainedModel("lr_multi", estimator.fit(rows), names, target)


def train_mlp(
    df: DataFrame,
    label: str | int,
    features: Sequence[str | int],
    *,
    layers: Sequence[int],
    iterations: int = 100,
    tol: float = 1e-6,
    seed: int | None = None,
    block_size: int = 128,
    step_size: float = 0.03,
    solver: str = "l-bfgs",
) -> TrainedModel:
    """Multilayer perceptron; the first layer counts the features, the last the classes."""
    names, target = resolve_all(df, features), resolve(df, label)
    sizes = [_number(size, int) for size in layers]
    if len(sizes) < 2 or sizes[0] != len(names):
        raise ValueError(f"layers {sizes} must start with the number of features, {len(names)}")
    estimator = MultilayerPerceptronClassifier(
        maxIter=_number(iterations, int),
        tol=_number(tol, float),
        seed=_number(seed, int),
        layers=sizes,
        blockSize=_number(block_size, int),
        stepSize=_number(step_size, float),
        solver=solver,
    )
    # Spark's trainer stacks the rows once and keeps the stacks itself: a copy of the rows beside them would only push them out of memory.
    return TrainedModel("mlp", estimator.fit(spread(points(df, names, target))), names, target)


def train_forest(
    df: DataFrame,
    label: str | int,
    features: Sequence[str | int],
    *,
    num_trees: int = 50,
    max_depth: int = 5,
    max_bins: int = 32,
    impurity: str = "gini",
    seed: int | None = None,
) -> TrainedModel:
    """Random forest for two or more classes of any type, indexed by frequency."""
    names, target = resolve_all(df, features), resolve(df, label)
    rows, indexer, classes, _ = _indexed_points(df, names, target, MAX_CLASSES)
    estimator = RandomForestClassifier(
        labelCol=INDEXED,
        numTrees=num_trees,
        maxDepth=max_depth,
        maxBins=max_bins,
        impurity=impurity,
        seed=seed,
    )
    with held(rows, _tree_row_bytes(rows, num_trees)) as kept:
        return TrainedModel("forest", estimator.fit(indexer.transform(kept)), names, target, classes)


# --- saving and loading -----------------------------------------------------------------------

_META_SCHEMA = "kind string, features array<string>, label string, classes array<string>, weights array<double>, threshold double"


def save_model(trained: TrainedModel, path: str, *, overwrite: bool = True) -> str:
    """Save to a directory: the fitted model, and a one-row table with its columns and classes."""
    spark = SparkSession.active()
    sgd = isinstance(trained.model, SgdSvmModel)
    meta = (
        trained.kind,
        trained.features,
        trained.label,
        trained.classes,
        trained.model.weights if sgd else None,
        trained.model.threshold if sgd else None,
    )
    mode = "overwrite" if overwrite else "errorifexists"
    spark.createDataFrame([meta], _META_SCHEMA).coalesce(1).write.mode(mode).json(f"{path}/columns")
    if not sgd:
        writer = trained.model.write()
        (writer.overwrite() if overwrite else writer).save(f"{path}/model")
    return path


def load_model(spark: SparkSession, path: str) -> TrainedModel:
    """Load what `save_model` wrote; the model knows its own family."""
    meta = spark.read.schema(_META_SCHEMA).json(f"{path}/columns").head()
    if meta["weights"] is not None:
        model = SgdSvmModel(list(meta["weights"]), meta["threshold"])
    else:
        model = _LOADERS[meta["kind"]].load(f"{path}/model")
    classes = None if meta["classes"] is None else list(meta["classes"])
    return TrainedModel(meta["kind"], model, list(meta["features"]), meta["label"], classes)


# --- inspection -------------------------------------------------------------------------------


def inspect_model(trained: TrainedModel) -> DataFrame:
    """Coefficients and intercepts, tree counts, or layer weights as rows of term and value."""
    model, names = trained.model, trained.features
    rows: list[tuple[str, float]] = []
    if isinstance(model, SgdSvmModel):
        rows = list(zip(names, model.weights))
    elif trained.kind == "svm":
        rows = [*zip(names, model.coefficients.toArray()), ("intercept", model.intercept)]
    elif trained.kind in ("lr", "lr_multi"):
        matrix, intercepts = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
        several = len(matrix) > 1
        for c, (weights, intercept) in enumerate(zip(matrix, intercepts)):
            suffix = f"[{c}]" if several else ""
            rows += [(name + suffix, w) for name, w in zip(names, weights)]
            rows.append(("intercept" + suffix, intercept))
        if model.hasSummary:
            rows.append(("iterations", model.summary.totalIterations))
            rows.append(("accuracy", _accuracy(model.summary)))
            if trained.kind == "lr":
                rows.append(("area_under_roc", model.summary.areaUnderROC))
    elif trained.kind in ("gbt", "forest"):
        rows = [("trees", model.getNumTrees), ("nodes", model.totalNumNodes)]
        rows += [(f"weight[{i}]", w) for i, w in enumerate(model.treeWeights)]
    elif trained.kind == "mlp":
        rows = [(f"weight[{i}]", w) for i, w in enumerate(model.weights.toArray())]
    typed = [(term, float(value)) for term, value in rows]
    return SparkSession.active().createDataFrame(typed, "term string, value double")


def _accuracy(summary: LogisticRegressionSummary) -> float:
    """The share of right predictions, as in the summary, whose own pass turns each row and its probabilities into objects."""
    right = F.col(summary.predictionCol) == F.col(summary.labelCol)
    return summary.predictions.agg(F.avg(right.cast("double"))).head()[0]


def model_settings(trained: TrainedModel) -> DataFrame:
    """What a model was trained on and with: rows of section, term and value, all as text.

    Models that were saved and loaded have the same settings; the SVM by descent has its threshold only.
    """
    rows = [("model", "kind", trained.kind), ("model", "label", trained.label)]
    rows += [("model", f"feature[{i}]", name) for i, name in enumerate(trained.features)]
    rows += [("model", f"class[{i}]", str(name)) for i, name in enumerate(trained.classes or [])]
    if isinstance(trained.model, SgdSvmModel):
        settings = {"threshold": trained.model.threshold}
    else:
        found = trained.model.extractParamMap()
        settings = {param.name: value for param, value in found.items() if not param.name.endswith("Col")}
    rows += [("parameter", name, _shown(value)) for name, value in sorted(settings.items())]
    return SparkSession.active().createDataFrame(rows, "section string, term string, value string")


def _shown(value: object) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value)


def tree_text(trained: TrainedModel) -> str:
    """The trees of a boosted or random forest in words."""
    if trained.kind not in ("gbt", "forest"):
        raise ValueError(f"a {trained.kind} model has no trees")
    return trained.model.toDebugString


def feature_importances(trained: TrainedModel) -> DataFrame:
    """Importance of each feature of a tree model."""
    if trained.kind not in ("gbt", "forest"):
        raise ValueError(f"a {trained.kind} model has no feature importances")
    values = trained.model.featureImportances.toArray()
    rows = [(name, float(value)) for name, value in zip(trained.features, values)]
    return SparkSession.active().createDataFrame(rows, "feature string, importance double")
