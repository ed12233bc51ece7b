"""Declared flows: nodes with an operator code and parameters, composed into lazy tables.

A flow is a dict {node id: {"name": code, "config": {"parameter": {...}, "fileUrl": [{parent: port}]}}}.
Building it calls the operators in dependency order. Tables stay lazy; only steps that must look
at data (fitting, statistics) run jobs. A table node without parent reads the path in its own
`fileUrl` entry, or takes the table given in `sources`.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from graphlib import TopologicalSorter

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from tablewright.functions import fixed_values as code
from tablewright.operators import explore, features, reshape, rows, scoring, training
from tablewright.operators.training import TrainedModel
from tablewright.sources.tables import read_table

Output = DataFrame | TrainedModel | tuple[DataFrame, ...]


class Outputs(dict):
    """The outputs of a flow's nodes by node id, with what is kept for them.

    A table that feeds several nodes is kept as long as one of the results made from it is still wanted. `release` gives
    results up, `close` all of them; as a context manager the outputs close themselves.
    """

    def __init__(self) -> None:
        super().__init__()
        self._kept: dict[str, set[str]] = {}

    def keep(self, node: str, results: set[str]) -> None:
        """Persist a node's table for the results that need it."""
        self[node] = self[node].persist(StorageLevel.MEMORY_AND_DISK)
        self._kept[node] = set(results)

    def kept(self) -> list[str]:
        return sorted(self._kept)

    def release(self, *results: str) -> None:
        for node, users in list(self._kept.items()):
            users.difference_update(results)
            if not users:
                del self._kept[node]
                self[node].unpersist()

    def close(self) -> None:
        self.release(*{result for users in self._kept.values() for result in users})

    def __enter__(self) -> Outputs:
        return self

    def __exit__(self, *exc: object) -> None:
        self.close()


def build(
    spec: Mapping[str, Mapping],
    sources: Mapping[str, DataFrame] | None = None,
    *,
    models: Mapping[str, TrainedModel] | None = None,
    start: str | None = None,
    given: Mapping[str, Output] | None = None,
    persist_shared: bool = False,
) -> Outputs:
    """The outputs of all nodes, or of `start` and everything after it.

    With `start`, outputs of earlier nodes come from `given`. `models` holds the models of load
    nodes by node id. `persist_shared` keeps tables that feed several nodes until the last nodes after them are
    released or the outputs closed; it pays when their computation costs more than writing them down.
    """
    parents = {node: _parents(node, config) for node, config in spec.items()}
    for node, found in parents.items():
        unknown = [p for p in found if p not in spec and p not in (given or {})]
        if unknown:
            raise ValueError(f"node {node!r} refers to unknown nodes {unknown}")
    order = [node for node in TopologicalSorter(parents).static_order() if node in spec]
    outputs = Outputs()
    outputs.update(given or {})
    wanted = set(order) if start is None else _descendants(start, order, parents)
    for node in order:
        if node not in wanted:
            continue
        missing = [p for p in _needed(node, spec, parents) if p not in outputs]
        if missing:
            raise ValueError(f"node {node!r} needs the outputs of {missing} in `given`")
        try:
            outputs[node] = _run(node, spec, outputs, sources or {}, models or {})
        except Exception:
            outputs.close()
            raise
        shared = sum(node in parents[other] for other in wanted) > 1
        if persist_shared and shared and isinstance(outputs[node], DataFrame):
            after = _descendants(node, order, parents) & wanted
            ends = {n for n in after if not any(n in parents[other] for other in wanted)}
            outputs.keep(node, ends)
    return outputs


def _edges(config: Mapping) -> list[tuple[str, object]]:
    urls = config.get("config", {}).get("fileUrl", [])
    return [(node, port) for entry in urls for node, port in entry.items()]


def _parents(node: str, config: Mapping) -> list[str]:
    named = [parent for parent, _ in _edges(config) if parent != node]
    return list(dict.fromkeys([*named, *[p for p in config.get("pre", []) if p]]))


def _needed(node: str, spec: Mapping[str, Mapping], parents: Mapping[str, list[str]]) -> list[str]:
    """The nodes whose outputs a node reads; an evaluation reads what its predict node was given."""
    if int(spec[node]["name"]) != code.EVALUATE:
        return parents[node]
    return [q for p in parents[node] if p in spec for q in (parents[p] if int(spec[p]["name"]) == code.PREDICT else [p])]


def _descendants(start: str, order: Sequence[str], parents: Mapping[str, list[str]]) -> set[str]:
    if start not in order:
        raise ValueError(f"the flow has no node {start!r}")
    reached = {start}
    for node in order:
        if any(parent in reached for parent in parents[node]):
            reached.add(node)
    return reached


def _run(
    node: str,
    spec: Mapping[str, Mapping],
    outputs: Mapping[str, Output],
    sources: Mapping[str, DataFrame],
    models: Mapping[str, TrainedModel],
) -> Output:
    config = spec[node]
    kind = int(config["name"])
    parameter = dict(config.get("config", {}).get("parameter") or {})
    inputs = [_port(outputs[parent], port) for parent, port in _edges(config) if parent != node and parent in outputs]
    if kind == code.READ:
        return _read(node, config, sources)
    if kind == code.LOAD_MODEL:
        if node in models:
            return models[node]
        return training.load_model(SparkSession.active(), parameter["path"])
    if kind == code.PREDICT:
        table, model = _table_and_model(node, inputs)
        return scoring.predict(
            model, table, features=parameter.get("features"), label=parameter.get("label")
        )
    if kind == code.EVALUATE:
        return _evaluate(node, spec, outputs, parameter)
    if kind not in OPERATORS:
        raise ValueError(f"node {node!r} has the unknown operator code {config['name']!r}")
    if not inputs or not isinstance(inputs[0], DataFrame):
        raise ValueError(f"node {node!r} needs a table")
    return OPERATORS[kind](inputs[0], parameter)


def _port(output: Output, port: object) -> DataFrame | TrainedModel:
    return output[int(port)] if isinstance(output, tuple) else output


def _read(node: str, config: Mapping, sources: Mapping[str, DataFrame]) -> DataFrame:
    if node in sources:
        return sources[node]
    paths = [path for owner, path in _edges(config) if owner == node]
    if not paths:
        raise ValueError(f"node {node!r} has neither a path nor a table in `sources`")
    return read_table(SparkSession.active(), paths[0])


def _table_and_model(node: str, inputs: Sequence[object]) -> tuple[DataFrame, TrainedModel]:
    tables = [x for x in inputs if isinstance(x, DataFrame)]
    models = [x for x in inputs if isinstance(x, TrainedModel)]
    if len(tables) != 1 or len(models) != 1:
        raise ValueError(f"node {node!r} needs one table and one model")
    return tables[0], models[0]


def _evaluate(
    node: str, spec: Mapping[str, Mapping], outputs: Mapping[str, Output], parameter: Mapping
) -> DataFrame:
    """Evaluation scores the table that its parent, a predict node, was given."""
    scored = [p for p in _parents(node, spec[node]) if p in spec and int(spec[p]["name"]) == code.PREDICT]
    if len(scored) != 1:
        raise ValueError(f"node {node!r} must follow one predict node")
    predict_config = spec[scored[0]]
    inputs = [_port(outputs[parent], port) for parent, port in _edges(predict_config)]
    table, model = _table_and_model(node, inputs)
    inputs_named = predict_config["config"]["parameter"].get("features")
    return scoring.evaluate(model, table, parameter["label"], features=inputs_named)


def _given(parameter: Mapping, **names: str) -> dict:
    """Keyword arguments for the parameters that are present."""
    return {keyword: parameter[key] for keyword, key in names.items() if parameter.get(key) not in (None, "")}


def _unwrap(parameter: Mapping) -> Mapping:
    inner = parameter.get("parameter")
    return inner if isinstance(inner, Mapping) else parameter


def _sort(df: DataFrame, parameter: Mapping) -> DataFrame:
    p = _unwrap(parameter)
    return rows.sort_rows(df, p["columnName"], p.get("sortType"))


def _count(value: object) -> int:
    return int(value)


OPERATORS: dict[int, Callable[[DataFrame, Mapping], Output]] = {
    code.FILTER: lambda df, p: rows.filter_rows(df, p["parameter"]),
    code.SORT: _sort,
    code.SPLIT_COLUMN: lambda df, p: reshape.split_column(
        df, p["columnName"], p["delimiter"], p.get("newColumnNames")
    ),
    code.SPLIT_ROWS: lambda df, p: reshape.split_rows(
        df, p["columnName"], p.get("newColumnName"), p.get("delimiter")
    ),
    code.MERGE_COLUMNS: lambda df, p: reshape.merge_columns(
        df, p["columnNames"], p.get("connector"), p.get("newColumnName")
    ),
    code.REPLACE: lambda df, p: reshape.replace_values(df, p["columnNames"], p["replaceCharacters"]),
    code.FILL_NULLS: lambda df, p: reshape.fill_nulls(df, p["parameter"]),
    code.MAP_COLUMNS: lambda df, p: reshape.map_columns(df, p["parameter"]),
    code.RANDOM_SPLIT: lambda df, p: rows.random_split(
        df, p["proportion1"], p["proportion2"], p.get("seed")
    ),
    code.QUANTILE_BINS: lambda df, p: features.quantile_bins(
        df, p["columnName"], p.get("newColumnName"), _count(p.get("numBuckets", 5)),
        **_given(p, relative_error="relativeError"),
    ),
    code.VECTOR_INDEX: lambda df, p: features.vector_index(
        df, p["columnNames"], p.get("newColumnName"), _count(p.get("maxCategories", 20))
    ),
    code.STANDARD_SCALE: lambda df, p: features.standard_scale(
        df, p["columnNames"], p.get("newColumnName")
    ),
    code.PCA_PROJECT: lambda df, p: features.pca(
        df, p["columnNames"], p.get("newColumnName"), _count(p.get("k", 3))
    ),
    code.STRING_INDEX: lambda df, p: features.string_index(
        df, p["columnName"], p.get("newColumnName")
    ),
    code.ONE_HOT: lambda df, p: features.one_hot(df, p["columnNames"], p.get("newColumnNames"), as_array=True),
    code.POLYNOMIAL: lambda df, p: features.polynomial(
        df, p["columnNames"], p.get("newColumnName"), _count(p.get("degree", 2))
    ),
    code.CHI_SQUARE: lambda df, p: features.chi_square(
        df, p["columnNames"], p["columnName_label"], p.get("newColumnName"),
        _count(p.get("numTopFeatures", 1)),
    ),
    code.DESCRIBE: lambda df, p: explore.describe_report(
        df, p["columnNames"], order_by=p.get("orderBy")
    ),
    code.FREQUENCY: lambda df, p: explore.frequency(df, p["columnName"]),
    code.CORRELATION: lambda df, p: explore.correlation_matrix(df, p["columnNames"]),
    code.SVM: lambda df, p: training.train_svm(
        df, p["label"], p["features"],
        **_given(p, iterations="iterations", step="step", reg_param="regParam", reg_type="regType",
                 convergence_tol="convergenceTol", engine="engine", keep="keep"),
    ),
    code.GBT: lambda df, p: training.train_gbt(
        df, p["label"], p["features"],
        **_given(p, iterations="iterations", step="step", max_depth="maxDepth",
                 min_instances_per_node="minInstancesPerNode", seed="seed"),
    ),
    code.LR_BINARY: lambda df, p: training.train_lr(
        df, p["label"], p["features"],
        **_given(p, iterations="iterations", reg_param="regParam", elastic_net_param="elasticNetParam",
                 tol="tol", fit_intercept="fitIntercept", threshold="threshold"),
    ),
    code.LR_MULTI: lambda df, p: training.train_lr_multi(
        df, p["label"], p["features"],
        **_given(p, iterations="iterations", reg_param="regParam", elastic_net_param="elasticNetParam",
                 tol="tol", fit_intercept="fitIntercept"),
    ),
    code.MLP: lambda df, p: training.train_mlp(
        df, p["label"], p["features"], layers=p["layers"],
        **_given(p, iterations="iterations", tol="tol", seed="seed", block_size="blockSize",
                 step_size="stepSize", solver="solver"),
    ),
}
