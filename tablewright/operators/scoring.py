"""Applying fitted classifiers and measuring how well they do."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from tablewright.functions.columns import as_double, quoted, resolve, resolve_all
from tablewright.functions.fixed_values import (
    METRIC_ACCURACY,
    METRIC_CORRECT,
    METRIC_LABEL,
    METRIC_PR,
    METRIC_ROC,
    VALUE_LABEL,
)
from tablewright.operators.training import FEATURES, LABEL, SgdSvmModel, TrainedModel, input_columns, model_settings, points
from tablewright.sources.layout import held


def predict(
    trained: TrainedModel,
    df: DataFrame,
    *,
    features: Sequence[str | int] | None = None,
    label: str | int | None = None,
    handle_invalid: str = "error",
) -> DataFrame:
    """Score a table; the result holds the prediction, the label if named, and the features.

    A support vector machine gives `prediction_result` and the label under its own name. Models
    trained on indexed labels also give `predicted_label`, the class the index stands for.
    """
    inputs = trained.features if features is None else features
    label = None if label == "" else label
    if len(resolve_all(df, inputs)) != len(trained.features):
        raise ValueError(f"the model takes {len(trained.features)} features")
    if trained.kind == "svm":
        scored = _svm_scores(trained, df, inputs, label, handle_invalid)
        shown = [F.col("prediction").alias("prediction_result")]
        if label is not None:
            shown.append(F.col(LABEL).alias(resolve(df, label)))
        return scored.select(*shown)
    rows = points(df, inputs, label, label_text=trained.classes is not None, handle_invalid=handle_invalid)
    scored = trained.model.transform(rows)
    shown = ["prediction"]
    if trained.classes is not None:
        scored = scored.withColumn("predicted_label", _class_of(trained.classes, F.col("prediction")))
        shown.append("predicted_label")
    return scored.select(*shown, *([] if label is None else [LABEL]), FEATURES)


def _class_of(classes: Sequence[str], index: Column) -> Column:
    return F.get(F.array(*[F.lit(c) for c in classes]), index.cast("int"))


def _svm_scores(
    trained: TrainedModel,
    df: DataFrame,
    inputs: Sequence[str | int],
    label: str | int | None,
    handle_invalid: str = "error",
) -> DataFrame:
    """Margin and 0/1 prediction, with the label if named."""
    if isinstance(trained.model, SgdSvmModel):
        margin = trained.model.margin(input_columns(df, inputs)).alias("margin")
        chosen = [margin] if label is None else [margin, as_double(df, resolve(df, label)).alias(LABEL)]
        scored = df.select(*chosen)
        if handle_invalid == "skip":
            scored = scored.where(F.col("margin").isNotNull())
        elif handle_invalid == "error":
            missing = F.raise_error(F.lit("a feature is null or no number")).cast("double")
            scored = scored.withColumn("margin", F.coalesce(F.col("margin"), missing))
        above = (F.col("margin") > F.lit(trained.model.threshold)).cast("double")
        return scored.withColumn("prediction", above)
    rows = trained.model.transform(points(df, inputs, label, handle_invalid=handle_invalid))
    margin = vector_to_array("rawPrediction")[1].alias("margin")
    return rows.select(margin, "prediction", *([] if label is None else [LABEL]))


def evaluate(
    trained: TrainedModel,
    df: DataFrame,
    label: str | int,
    *,
    features: Sequence[str | int] | None = None,
    score: str | None = None,
) -> DataFrame:
    """The four binary metrics of a support vector machine or a logistic regression.

    The areas are taken on the margin of a support vector machine and on the 0/1 predictions of a
    logistic regression, unless `score` says `raw` or `hard`.
    """
    inputs = trained.features if features is None else features
    score = score or ("raw" if trained.kind == "svm" else "hard")
    if trained.kind == "svm":
        scored = _svm_scores(trained, df, inputs, label)
    elif trained.kind == "lr":
        margin = vector_to_array("rawPrediction")[1].alias("margin")
        scored = trained.model.transform(points(df, inputs, label)).select(margin, "prediction", LABEL)
    else:
        raise ValueError(f"a {trained.kind} model has no binary evaluation")
    return binary_metrics(scored, LABEL, "prediction", "margin" if score == "raw" else None)


def model_report(
    trained: TrainedModel, df: DataFrame, label: str | int, *, features: Sequence[str | int] | None = None, score: str | None = None
) -> DataFrame:
    """A model's settings together with its metrics on a table, which need not be the one it was trained on.

    Support vector machines and logistic regressions get the four binary metrics, other models accuracy and
    weighted precision.
    """
    if trained.kind in ("svm", "lr"):
        metrics = evaluate(trained, df, label, features=features, score=score)
    else:
        scored = predict(trained, df, features=features, label=label)
        guess = "prediction" if trained.classes is None else "predicted_label"
        metrics = multiclass_metrics(scored.withColumn(LABEL, F.col(LABEL).cast(scored.schema[guess].dataType)), LABEL, guess)
    shown = metrics.select(F.lit("metric").alias("section"), quoted(METRIC_LABEL).alias("term"), quoted(VALUE_LABEL).cast("string").alias("value"))
    return model_settings(trained).unionByName(shown)


def binary_metrics(
    df: DataFrame,
    label: str | int,
    prediction: str | int,
    score: str | int | None = None,
) -> DataFrame:
    """Correct count, accuracy and the areas under the PR and ROC curves, one row each.

    With a score column the curves run through every distinct score. Without one the 0/1
    predictions are the score; their curve has one inner point, so counts are enough.
    """
    actual = as_double(df, resolve(df, label))
    predicted = as_double(df, resolve(df, prediction))
    if score is None:
        return _hard_metrics(df.select(actual.alias("y"), predicted.alias("p")))
    rows = df.select(actual.alias("y"), predicted.alias("p"), as_double(df, resolve(df, score)).alias("s"))
    return _curve_metrics(rows)


# Ranges that the distinct scores are cut into; each is sorted by a task of its own.
RANGES = 256


def _curve_metrics(rows: DataFrame) -> DataFrame:
    """All four metrics through every distinct score, from one scan of the rows and one sort of their distinct scores.

    Counts before a score are prefix sums on two levels: over RANGES ranges of scores, which are few rows, and within
    each range. Both curves are summed up in the same pass. Rows without a label or a score are left out.
    """
    up, good = F.col("y") > 0.5, F.col("y") == F.col("p")
    known = rows.where(F.col("y").isNotNull() & F.col("s").isNotNull())
    points = known.groupBy("s").agg(
        F.count_if(up).cast("double").alias("up"), F.count_if(~up).cast("double").alias("down"), F.count_if(good).cast("double").alias("good")
    )
    with held(points) as scores:
        cuts = scores.agg(F.percentile_approx("s", [i / RANGES for i in range(1, RANGES)], 10_000).alias("cuts")).head()["cuts"] or []
        part = _range_of(F.col("s"), sorted(set(cuts)))
        counts = ("up", "down", "good")
        totals = scores.groupBy(part.alias("part")).agg(*[F.sum(c).alias(f"{c}_part") for c in counts])
        above = Window.orderBy(F.col("part").desc()).rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows at most
        whole = Window.orderBy(F.col("part").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        offsets = totals.select(
            "part", *[F.coalesce(F.sum(f"{c}_part").over(above), F.lit(0.0)).alias(f"{c}_above") for c in counts[:2]],
            *[F.sum(f"{c}_part").over(whole).alias(f"{c}_all") for c in counts],
        )
        inside = Window.partitionBy("part").orderBy(F.col("s").desc()).rowsBetween(Window.unboundedPreceding, -1)
        ranked = scores.withColumn("part", part).join(F.broadcast(offsets), "part")
        ranked = ranked.select("*", *[(F.col(f"{c}_above") + F.coalesce(F.sum(c).over(inside), F.lit(0.0))).alias(f"{c}_before") for c in counts[:2]])
        up_before, down_before, up_now, down_now = (F.col(c) for c in ("up_before", "down_before", "up", "down"))
        tp, fp = up_before + up_now, down_before + down_now
        precise = tp / (tp + fp)
        precise_before = F.coalesce(F.try_divide(up_before, up_before + down_before), precise)
        areas = ranked.agg(
            F.sum(up_now * (precise + precise_before) / 2).alias("pr"), F.sum(down_now * (up_before + up_now / 2)).alias("roc"),
            *[F.max(f"{c}_all").alias(f"{c}_all") for c in counts],
        ).head()
    pos, neg, correct = (areas[f"{c}_all"] or 0.0 for c in counts)
    under_pr = areas["pr"] / pos if pos else 0.0
    # Without negatives the curve is the line from its last point to the corner; without positives its points lie at 0.
    under_roc = areas["roc"] / (pos * neg) if pos and neg else 0.5 + (pos > 0) / 2 if not neg else 0.0
    report = [
        (METRIC_CORRECT, float(correct)), (METRIC_ACCURACY, correct / (pos + neg) if pos + neg else None),
        (METRIC_PR, float(under_pr)), (METRIC_ROC, float(under_roc)),
    ]
    return rows.sparkSession.createDataFrame(report, f"`{METRIC_LABEL}` string, `{VALUE_LABEL}` double")


def _range_of(value: Column, cuts: Sequence[float]) -> Column:
    """How many cuts lie below the value, by halving: the expression is as deep as the logarithm of their number."""
    def between(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value > F.lit(cuts[middle]), between(middle + 1, high)).otherwise(between(low, middle))

    return between(0, len(cuts))


def _hard_metrics(rows: DataFrame) -> DataFrame:
    """All four metrics from the four counts of one aggregate."""
    y, p = F.col("y") == 1, F.col("p") == 1

    def count(condition: Column, name: str) -> Column:
        return F.count(F.when(condition, F.lit(1))).cast("double").alias(name)

    counts = rows.agg(
        count(F.col("y") == F.col("p"), "correct"),
        F.count("*").cast("double").alias("n"),
        count(y & p, "tp"),
        count(~y & p, "fp"),
        count(y, "pos"),
        count(~y, "neg"),
    )
    tp, fp, pos, neg = (F.col(c) for c in ("tp", "fp", "pos", "neg"))
    n = pos + neg
    recall, fall_out = F.coalesce(F.try_divide(tp, pos), F.lit(0.0)), F.coalesce(F.try_divide(fp, neg), F.lit(0.0))
    base = F.try_divide(pos, n)
    # Without any positive prediction the curve starts at its only point, where recall is 1.
    precision = F.coalesce(F.try_divide(tp, tp + fp), base)
    under_pr = recall * precision + (1 - recall) * (precision + base) / 2
    under_roc = fall_out * recall / 2 + (1 - fall_out) * (recall + 1) / 2
    rows = [
        (METRIC_CORRECT, F.col("correct")),
        (METRIC_ACCURACY, F.try_divide(F.col("correct"), F.col("n"))),
        (METRIC_PR, under_pr),
        (METRIC_ROC, under_roc),
    ]
    pairs = [F.struct(F.lit(name).alias(METRIC_LABEL), value.alias(VALUE_LABEL)) for name, value in rows]
    return counts.select(F.inline(F.array(*pairs)))


def multiclass_metrics(df: DataFrame, label: str | int, prediction: str | int) -> DataFrame:
    """Accuracy and weighted precision from the counts of label and prediction pairs."""
    pairs = df.select(
        quoted(resolve(df, label)).alias("y"), quoted(resolve(df, prediction)).alias("p")
    ).where(F.col("y").isNotNull() & F.col("p").isNotNull())
    cells = pairs.groupBy("y", "p").agg(F.count("*").cast("double").alias("n"))
    hit = F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0.0)
    # Each class once as a label and once as a prediction, so that both totals meet in one group.
    sides = F.array(
        F.struct(F.col("y").alias("k"), F.col("n").alias("actual"), F.lit(0.0).alias("predicted"), hit.alias("hit")),
        F.struct(F.col("p").alias("k"), F.lit(0.0).alias("actual"), F.col("n").alias("predicted"), F.lit(0.0).alias("hit")),
    )
    classes = cells.select(F.inline(sides)).groupBy("k").agg(
        F.sum("actual").alias("actual"), F.sum("predicted").alias("predicted"), F.sum("hit").alias("hit")
    )
    total = F.sum("actual")
    weighted = F.sum(F.col("actual") * F.coalesce(F.try_divide(F.col("hit"), F.col("predicted")), F.lit(0.0)))
    totals = classes.agg(
        F.try_divide(F.sum("hit"), total).alias("accuracy"),
        F.try_divide(weighted, total).alias("weighted_precision"),
    )
    rows = [
        F.struct(F.lit(name).alias(METRIC_LABEL), F.col(name).alias(VALUE_LABEL))
        for name in ("accuracy", "weighted_precision")
    ]
    return totals.select(F.inline(F.array(*rows)))
