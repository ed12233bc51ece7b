"""The same results in SQL, for checking the queries against another engine."""

from __future__ import annotations

FILTER_WHERE = """
    l_quantity > 30 AND l_returnflag = 'R' OR l_discount >= 0.09 AND l_linestatus <> 'F'
"""

GAPS = """
    SELECT l_orderkey, l_partkey,
           CASE WHEN l_linenumber % 3 <> 0 THEN l_discount END AS discount,
           CASE WHEN l_linenumber % 3 <> 0 THEN l_linenumber END AS line,
           CASE WHEN l_linenumber % 3 <> 0 THEN l_tax END AS tax
    FROM lineitem
"""


def _fill(aggregate: str) -> str:
    return f"""
    WITH g AS ({GAPS}),
         s AS (SELECT {aggregate}(discount) AS d, CAST(trunc({aggregate}(line)) AS INTEGER) AS l, {aggregate}(tax) AS t FROM g)
    SELECT l_orderkey, l_partkey, round(coalesce(discount, d), 6) AS discount,
           coalesce(line, l) AS line, round(coalesce(tax, t), 6) AS tax
    FROM g, s
    """


def _statistics(table: str, column: str, order_by: str | None = None) -> str:
    places = "CAST(NULL AS BIGINT) AS min_position, CAST(NULL AS BIGINT) AS max_position"
    if order_by:
        places = f"""
            (SELECT place FROM (SELECT {column} AS v, row_number() OVER (ORDER BY {order_by}) - 1 AS place FROM {table})
             WHERE v IS NOT NULL ORDER BY v, place LIMIT 1) AS min_position,
            (SELECT place FROM (SELECT {column} AS v, row_number() OVER (ORDER BY {order_by}) - 1 AS place FROM {table})
             WHERE v IS NOT NULL ORDER BY v DESC, place LIMIT 1) AS max_position"""
    return f"""
    SELECT '{column}' AS "column", 'number' AS type, count({column}) AS count, {places},
           round(CAST(min({column}) AS DOUBLE), 6) AS min, round(CAST(max({column}) AS DOUBLE), 6) AS max,
           round(quantile_cont(CAST({column} AS DOUBLE), 0.25), 4) AS q25,
           round(quantile_cont(CAST({column} AS DOUBLE), 0.5), 4) AS median,
           round(quantile_cont(CAST({column} AS DOUBLE), 0.75), 4) AS q75,
           round(avg({column}), 4) AS mean,
           round((SELECT avg(abs({column} - m)) FROM {table}, (SELECT avg({column}) AS m FROM {table})), 4) AS mean_abs_dev,
           round(var_samp({column}), 1) AS variance, round(stddev_samp({column}), 4) AS std,
           round(skewness({column}), 6) AS skewness, round(kurtosis({column}), 6) AS kurtosis
    FROM {table}
    """


def _text_statistics(table: str, column: str) -> str:
    nothing = ", ".join(
        f"CAST(NULL AS DOUBLE) AS {name}"
        for name in ("min", "max", "q25", "median", "q75", "mean", "mean_abs_dev", "variance", "std", "skewness", "kurtosis")
    )
    return f"""
    SELECT '{column}' AS "column", 'text' AS type, count({column}) AS count,
           CAST(NULL AS BIGINT) AS min_position, CAST(NULL AS BIGINT) AS max_position, {nothing}
    FROM {table}
    """


DESCRIBED = """
    WITH d AS (SELECT *, CASE WHEN l_linenumber % 3 <> 0 THEN l_discount END AS discount FROM lineitem)
"""

CORRELATED = """
    WITH c AS (
        SELECT l_quantity, l_extendedprice,
               CASE WHEN l_linenumber % 3 <> 0 THEN l_discount END AS discount,
               CASE WHEN l_linenumber % 2 <> 0 THEN l_tax END AS tax
        FROM lineitem)
"""


def _correlation_rows() -> str:
    names = ["l_quantity", "l_extendedprice", "discount", "tax"]
    rows = []
    for left in [*names, "same"]:
        for right in [*names, "same"]:
            if "same" in (left, right):
                value = "CAST(NULL AS DOUBLE)"
            elif left == right:
                value = "CAST(1 AS DOUBLE)"
            else:
                value = f"round((SELECT corr({left}, {right}) FROM c), 6)"
            rows.append(f"SELECT '{left}' AS \"left\", '{right}' AS \"right\", {value} AS correlation")
    return CORRELATED + " UNION ALL ".join(rows)


def _correlation_matrix() -> str:
    names = ["l_extendedprice", "discount", "tax"]
    rows = []
    for left in names:
        cells = [
            f"CAST(1 AS DOUBLE) AS {right}" if left == right
            else f"round((SELECT corr({left}, {right}) FROM c), 6) AS {right}"
            for right in names
        ]
        rows.append(f"SELECT '{left}' AS \"column\", {', '.join(cells)}")
    return CORRELATED + " UNION ALL ".join(rows)


def _bins(column: str, buckets: int) -> str:
    shares = ", ".join(str(i / buckets) for i in range(1, buckets))
    return f"""
    WITH s AS (SELECT list_sort(list_distinct(quantile_disc({column}, [{shares}]))) AS splits FROM lineitem)
    SELECT l_orderkey, l_partkey, {column},
           CAST(len(list_filter(splits, lambda x: x <= {column})) AS DOUBLE) AS bin
    FROM lineitem, s
    """


def _category(column: str) -> str:
    """Index by ascending value with 0 moved to the front."""
    return f"(SELECT value AS v, row_number() OVER (ORDER BY value <> 0, value) - 1 AS i FROM (SELECT DISTINCT {column} AS value FROM lineitem))"


def _listing(table: str, columns: dict[str, tuple[str, bool]]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{name}' AS "column", '{kind}' AS type, {str(numeric).upper()} AS is_numeric, count({name}) AS non_null,
        count(CASE WHEN isfinite(try_cast({name} AS DOUBLE)) THEN 1 END) AS numeric_values FROM {table}"""
        for name, (kind, numeric) in columns.items()
    )


FLAGGED = """
    WITH f AS (SELECT *, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS flag FROM lineitem)
"""


def _chi_square(column: str) -> str:
    return f"""
    SELECT '{column}' AS "column",
           round(sum((coalesce(n, 0) - e) * (coalesce(n, 0) - e) / e), 4) AS statistic,
           (count(DISTINCT v) - 1) * (count(DISTINCT flag) - 1) AS degrees_of_freedom,
           -- with an even number of degrees the tail is a finite sum
           round(CAST(list_sum(list_transform(range(0, (count(DISTINCT v) - 1) * (count(DISTINCT flag) - 1) // 2), lambda k:
               exp(k * ln(sum((coalesce(n, 0) - e) * (coalesce(n, 0) - e) / e) / 2) - lgamma(k + 1) - sum((coalesce(n, 0) - e) * (coalesce(n, 0) - e) / e) / 2)
           )) AS DOUBLE), 8) AS p_value
    FROM (SELECT a.v, b.flag, a.n * b.n * 1.0 / t.n AS e
          FROM (SELECT {column} AS v, count(*) AS n FROM f GROUP BY 1) a,
               (SELECT flag, count(*) AS n FROM f GROUP BY 1) b, (SELECT count(*) AS n FROM f) t)
    LEFT JOIN (SELECT {column} AS v, flag, count(*) AS n FROM f GROUP BY 1, 2) USING (v, flag)
    """


PCA_PARTS = """
    WITH m AS (SELECT var_samp(l_discount) AS a, var_samp(l_tax) AS c, covar_samp(l_discount, l_tax) AS b FROM lineitem),
         e AS (SELECT a, b, c, (a + c) / 2 + sqrt(((a - c) / 2) * ((a - c) / 2) + b * b) AS l1 FROM m),
         v AS (SELECT a, c, l1, (l1 - c) / sqrt((l1 - c) * (l1 - c) + b * b) AS x,
                      b / sqrt((l1 - c) * (l1 - c) + b * b) AS y FROM e)
"""



def _curve(actual: str, score: str, predicted: str, where: str = "TRUE") -> str:
    """The four metrics of 0/1 labels, with both curves through every distinct score."""
    return f"""
    WITH r AS (SELECT {actual} AS y, {score} AS s, {predicted} AS p FROM lineitem WHERE {where}),
         g AS (SELECT s, sum(y) AS up, sum(1 - y) AS down FROM r GROUP BY s),
         c AS (SELECT s, CAST(sum(up) OVER w AS DOUBLE) AS tp, CAST(sum(down) OVER w AS DOUBLE) AS fp FROM g WINDOW w AS (ORDER BY s DESC)),
         t AS (SELECT CAST(sum(y) AS DOUBLE) AS pos, CAST(sum(1 - y) AS DOUBLE) AS neg, count(*) AS n,
                      sum(CASE WHEN y = p THEN 1 ELSE 0 END) AS good FROM r),
         q AS (SELECT s, tp / pos AS tpr, fp / neg AS fpr, tp / (tp + fp) AS prec FROM c, t),
         k AS (SELECT tpr, fpr, prec, coalesce(lag(tpr) OVER w, 0) AS tpr0, coalesce(lag(fpr) OVER w, 0) AS fpr0,
                      coalesce(lag(prec) OVER w, prec) AS prec0 FROM q WINDOW w AS (ORDER BY s DESC))
    SELECT '正确个数' AS metric, CAST(good AS DOUBLE) AS value FROM t
    UNION ALL SELECT '精准度', round(good * 1.0 / n, 8) FROM t
    UNION ALL SELECT 'Area under PR', round(sum((tpr - tpr0) * (prec + prec0) / 2), 8) FROM k
    UNION ALL SELECT 'Area under ROC', round(sum((fpr - fpr0) * (tpr + tpr0) / 2), 8) FROM k
    """


FLOW = f"""
    SELECT l_quantity * 2 + (l_linenumber + 0.5) AS score, count(*) AS rows
    FROM lineitem WHERE {FILTER_WHERE} GROUP BY 1
"""

IS_BIG = "CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END"
NOISY = f"xor({IS_BIG}, CASE WHEN l_partkey % 7 = 0 THEN 1 ELSE 0 END)"
RULE = ("CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END", "l_quantity", IS_BIG)

# The most frequent class of each line number, which unregularised models of line number marks must find.
CLASSES = """
    WITH f AS (SELECT l_linenumber, CASE WHEN l_partkey % 10 = 0 THEN (c + 1) % 3 ELSE c END AS flag
               FROM (SELECT *, CASE WHEN l_linenumber <= 2 THEN 0 WHEN l_linenumber <= 4 THEN 1 ELSE 2 END AS c FROM lineitem)),
         m AS (SELECT l_linenumber, mode(flag) AS guess FROM f GROUP BY l_linenumber)
    SELECT CAST(guess AS DOUBLE) AS prediction, CAST(flag AS DOUBLE) AS label,
""" + ", ".join(f"CAST(l_linenumber = {i} AS DOUBLE) AS line{i}" for i in range(1, 8)) + " FROM f JOIN m USING (l_linenumber)"


def _by_frequency(label: str, text: str, features: str) -> str:
    """A right guess of a label that is indexed by falling frequency."""
    return f"""
    WITH f AS (SELECT {label} AS label, * FROM lineitem),
         i AS (SELECT label, row_number() OVER (ORDER BY count(*) DESC, CAST(label AS VARCHAR)) - 1 AS i FROM f GROUP BY label)
    SELECT CAST(i AS DOUBLE) AS prediction, {text} AS predicted_label, label, {features} FROM f JOIN i USING (label)
    """


def _report_rows() -> str:
    """Settings of a model, and its metrics on the odd orders."""
    words = {("model", "kind"): "lr", ("model", "label"): "noisy", ("model", "feature[0]"): "above_middle", ("parameter", "family"): "auto",
             ("parameter", "fitIntercept"): "true", ("parameter", "standardization"): "true"}
    numbers = {("parameter", "aggregationDepth"): 2, ("parameter", "maxBlockSizeInMB"): 0, ("parameter", "elasticNetParam"): 0.5, ("parameter", "maxIter"): 20,
               ("parameter", "regParam"): 0, ("parameter", "threshold"): 0.5, ("parameter", "tol"): 1e-6}
    rows = [f"SELECT '{s}' AS section, '{t}' AS term, '{w}' AS word, CAST(NULL AS DOUBLE) AS number" for (s, t), w in words.items()]
    rows += [f"SELECT '{s}', '{t}', NULL, CAST({n} AS DOUBLE)" for (s, t), n in numbers.items()]
    metrics = _curve(NOISY, IS_BIG, IS_BIG, "l_orderkey % 2 = 1")
    return " UNION ALL ".join([*rows, f"SELECT 'metric', metric, NULL, value FROM ({metrics})"])


ORACLE: dict[str, str] = {
    "csv_roundtrip": "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer",
    "csv_text_roundtrip": """
        SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, CAST(s_nationkey AS VARCHAR) AS s_nationkey,
               CAST(s_acctbal AS VARCHAR) AS s_acctbal FROM supplier""",
    "csv_headerless": """
        SELECT CAST(p_partkey AS VARCHAR) AS "_c0", p_name AS "_c1", p_brand AS "_c2", p_type AS "_c3",
               CAST(p_size AS VARCHAR) AS "_c4", CAST(p_retailprice AS VARCHAR) AS "_c5" FROM part""",
    "json_roundtrip": "SELECT * FROM orders",
    "text_length": "SELECT CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS total_length FROM documents",
    "preview_slice": "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100",
    "preview_deep": """
        SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate
        FROM (SELECT *, row_number() OVER (ORDER BY l_shipdate, l_extendedprice, l_orderkey, l_linenumber, l_partkey) - 1 AS place,
                     count(*) OVER () AS n FROM lineitem)
        WHERE place >= n - n // 5 AND place < n - n // 5 + n // 20""",
    "head_json": """
        SELECT CAST(to_json(struct_pack(o_orderkey := o_orderkey, o_custkey := o_custkey, o_orderstatus := o_orderstatus,
               o_totalprice := o_totalprice, o_orderdate := strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%g'), o_orderpriority := o_orderpriority)) AS VARCHAR) AS json
        FROM (SELECT * FROM orders LIMIT 50)""",
    "column_listing": _listing("events", {
        "event_id": ("bigint", True), "ts": ("timestamp_ntz", False), "user_id": ("bigint", True), "event_type": ("string", False),
        "value": ("double", True), "props": ("string", False)}),
    "column_listing_numeric": _listing("lineitem", {
        "l_orderkey": ("bigint", True), "l_partkey": ("bigint", True), "l_suppkey": ("bigint", True),
        "l_linenumber": ("int", True), "l_quantity": ("double", True), "l_extendedprice": ("double", True),
        "l_discount": ("double", True), "l_tax": ("double", True)}),
    "filter_multi": f"SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_returnflag, l_linestatus FROM lineitem WHERE {FILTER_WHERE}",
    "filter_patterns": """
        SELECT * FROM part WHERE p_name LIKE 's%' AND p_size <= 25
            OR regexp_matches(p_type, '^(ECO|PRO)') AND p_retailprice < 1000.5""",
    "filter_dates": """
        SELECT o_orderkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders
        WHERE o_orderdate >= TIMESTAMP '1997-06-01' AND o_orderdate < TIMESTAMP '1998-06-01' AND o_orderstatus <> 'P'""",
    "filter_number_in_text": """
        SELECT event_id, regexp_extract(props, '"k": ([0-9]+)', 1) AS k FROM events
        WHERE CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS DOUBLE) > 49.5""",
    "filter_chain": """
        SELECT o_orderkey, o_totalprice, o_orderstatus, o_orderpriority
        FROM (SELECT * FROM (SELECT * FROM orders WHERE o_totalprice > 50000 AND o_orderstatus = 'O')
              WHERE o_orderpriority = '1-URGENT' OR o_orderpriority = '5-LOW')
        WHERE o_totalprice <= 400000""",
    "sort_desc": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC",
    "sort_top": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 20",
    "sort_asc_nulls": """
        SELECT l_orderkey, l_partkey, CASE WHEN l_linenumber % 3 <> 0 THEN l_discount END AS discount
        FROM lineitem ORDER BY discount NULLS FIRST""",
    "split_column": """
        SELECT o_orderkey, o_orderpriority, strftime(o_orderdate, '%Y-%m-%d') AS day,
               strftime(o_orderdate, '%Y') AS year, strftime(o_orderdate, '%m') AS month,
               string_split(o_orderpriority, '-')[1] AS rank, string_split(o_orderpriority, '-')[2] AS word,
               string_split(o_orderpriority, '-')[3] AS missing FROM orders""",
    "split_column_auto": """
        SELECT c_custkey, c_name, string_split(c_name, '#')[1] AS c_name_split_1,
               string_split(c_name, '#')[2] AS c_name_split_2 FROM customer""",
    "split_rows": "SELECT o_orderkey, o_orderpriority, unnest(string_split(o_orderpriority, '-')) AS piece FROM orders",
    "split_rows_delimiter": "SELECT doc_id, unnest(string_split(text, '. ')) AS sentence FROM documents",
    "merge_columns": """
        SELECT p_partkey, concat_ws('-', CASE WHEN p_size > 10 THEN p_type END, p_brand, p_name) AS full_name FROM part""",
    "replace_values": """
        SELECT c_custkey, c_acctbal, CAST(c_nationkey AS VARCHAR) AS c_nationkey,
               regexp_replace(regexp_replace(c_mktsegment, 'MACHINERY|FURNITURE', 'GOODS', 'g'), 'GOODS', 'goods copy', 'g') AS c_mktsegment,
               regexp_replace(c_name, 'Customer#0*([0-9]+)', 'customer \\1', 'g') AS c_name
        FROM customer""",
    "fill_nulls_mean": _fill("avg"),
    "fill_nulls_max": _fill("max"),
    "fill_nulls_min": _fill("min"),
    "map_columns": """
        SELECT l_orderkey, l_partkey, round((l_extendedprice + 100) + (l_quantity * 0.0001::DOUBLE), 5) AS shifted,
               round((l_linenumber * 0.5::DOUBLE) / nullif(l_tax * 100::DOUBLE, 0), 6) AS ratio,
               CAST(NULL AS DOUBLE) AS nothing,
               round((l_extendedprice + 100) + (l_quantity * 0.0001::DOUBLE) - 1, 5) AS again
        FROM lineitem""",
    "random_split": "SELECT o_orderkey, o_totalprice FROM orders",
    "scatter_sample": """
        SELECT l_quantity, l_extendedprice FROM lineitem
        ORDER BY md5(concat_ws(chr(1), '7', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR)))
        LIMIT 50""",
    "hash_split": """
        SELECT o_orderkey, o_totalprice,
               CASE WHEN CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) % 10000 < 7000 THEN 0 ELSE 1 END AS port
        FROM orders""",
    "describe": DESCRIBED + " UNION ALL ".join([
        _statistics("d", "l_quantity"), _statistics("d", "l_extendedprice"), _text_statistics("d", "l_returnflag"),
        _statistics("d", "l_linenumber"), _statistics("d", "discount")]),
    "describe_positions": " UNION ALL ".join([
        _statistics("events", "value", "event_id"), _statistics("events", "user_id", "event_id"),
        _text_statistics("events", "event_type")]),
    "describe_report": """
        WITH p AS (SELECT o_custkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS place FROM orders)
        , m AS (SELECT avg(o_custkey) AS mean FROM orders)
        , v AS (
            SELECT '总数' AS statistic, CAST(count(o_custkey) AS DOUBLE) AS x, CAST(count(o_orderstatus) AS VARCHAR) AS o_orderstatus FROM orders
            UNION ALL SELECT '最小值', min(o_custkey), '' FROM orders
            UNION ALL SELECT '最大值', max(o_custkey), '' FROM orders
            UNION ALL SELECT '最小值位置', min(place), '' FROM p WHERE o_custkey = (SELECT min(o_custkey) FROM p)
            UNION ALL SELECT '最大值位置', min(place), '' FROM p WHERE o_custkey = (SELECT max(o_custkey) FROM p)
            UNION ALL SELECT '25%分位数', quantile_cont(CAST(o_custkey AS DOUBLE), 0.25), '' FROM orders
            UNION ALL SELECT '中位数', quantile_cont(CAST(o_custkey AS DOUBLE), 0.5), '' FROM orders
            UNION ALL SELECT '75%分位数', quantile_cont(CAST(o_custkey AS DOUBLE), 0.75), '' FROM orders
            UNION ALL SELECT '均值', mean, '' FROM m
            UNION ALL SELECT '平均绝对偏差', avg(abs(o_custkey - mean)), '' FROM orders, m
            UNION ALL SELECT '方差', var_samp(o_custkey), '' FROM orders
            UNION ALL SELECT '标准差', stddev_samp(o_custkey), '' FROM orders
            UNION ALL SELECT '偏度', skewness(o_custkey), '' FROM orders
            UNION ALL SELECT '峰度', kurtosis(o_custkey), '' FROM orders)
        SELECT statistic, CAST(NULL AS VARCHAR) AS word, CASE WHEN abs(x) >= 100 THEN round(x, 1) ELSE round(x, 6) END AS number, o_orderstatus FROM v
        UNION ALL SELECT '类型', 'number', NULL, 'text'""",
    "frequency": 'SELECT event_type, count(*) AS "频率" FROM events WHERE event_type IS NOT NULL GROUP BY event_type',
    "frequency_nulls": f"SELECT CAST(line AS BIGINT) AS line, count(*) AS rows FROM ({GAPS}) WHERE line IS NOT NULL GROUP BY 1",
    "correlation": _correlation_rows(),
    "correlation_matrix": _correlation_matrix(),
    "assemble_array": """
        SELECT l_orderkey, l_partkey, l_quantity::FLOAT::DOUBLE AS x, l_discount::FLOAT::DOUBLE AS y FROM lineitem""",
    "quantile_bins": _bins("l_extendedprice", 10),
    "quantile_bins_ties": _bins("l_tax", 20),
    "vector_index": f"""
        SELECT l_orderkey, l_partkey, CAST(a.i AS DOUBLE) AS line, CAST(b.i AS DOUBLE) AS tax, l_quantity AS quantity
        FROM lineitem JOIN {_category('l_linenumber')} a ON l_linenumber = a.v JOIN {_category('l_tax')} b ON l_tax = b.v""",
    "standard_scale": """
        SELECT l_orderkey, l_partkey, round(l_quantity / s.q, 4) AS quantity, round(l_discount / s.d, 4) AS discount
        FROM lineitem, (SELECT stddev_samp(l_quantity) AS q, stddev_samp(l_discount) AS d FROM lineitem) s""",
    "standard_scale_centred": """
        SELECT l_orderkey, l_partkey, round((l_quantity - s.m) / s.q, 5) AS quantity
        FROM lineitem, (SELECT stddev_samp(l_quantity) AS q, avg(l_quantity) AS m FROM lineitem) s""",
    "pca": PCA_PARTS + "SELECT l_orderkey, l_partkey, round(abs(l_discount * x + l_tax * y), 5) AS length FROM lineitem, v",
    "pca_variance": PCA_PARTS + "SELECT CAST(0 AS INTEGER) AS component, round(l1 / (a + c), 6) AS explained_variance FROM v",
    "string_index": """
        SELECT c_custkey, c_mktsegment, CAST(i AS DOUBLE) AS segment_index FROM customer
        JOIN (SELECT c_mktsegment, row_number() OVER (ORDER BY count(*) DESC, c_mktsegment) - 1 AS i
              FROM customer GROUP BY c_mktsegment) USING (c_mktsegment)""",
    "string_index_join": """
        SELECT l_orderkey, l_linenumber, l_partkey, CAST(i AS DOUBLE) AS part_index FROM lineitem
        JOIN (SELECT l_partkey, row_number() OVER (ORDER BY count(*) DESC, CAST(l_partkey AS VARCHAR)) - 1 AS i
              FROM lineitem GROUP BY l_partkey) USING (l_partkey)""",
    "string_index_fitted": """
        WITH k AS (SELECT l_partkey, row_number() OVER (ORDER BY count(*) DESC, CAST(l_partkey AS VARCHAR)) - 1 AS i
                   FROM lineitem WHERE l_linenumber <= 3 GROUP BY l_partkey)
        SELECT l_orderkey, l_linenumber, l_partkey, CAST(coalesce(i, (SELECT count(*) FROM k)) AS DOUBLE) AS part_index
        FROM lineitem LEFT JOIN k USING (l_partkey)""",
    "scaled_and_saved": """
        SELECT l_orderkey, l_partkey, round((l_quantity - q) / qs, 5) AS quantity, round((l_tax - p) / ps, 5) AS tax
        FROM lineitem, (SELECT avg(l_quantity) AS q, stddev_samp(l_quantity) AS qs, avg(l_tax) AS p, stddev_samp(l_tax) AS ps
                        FROM lineitem WHERE l_orderkey % 3 = 0)""",
    "one_hot": "SELECT l_orderkey, l_partkey, "
    + ", ".join(f"CAST(l_linenumber = {i} AS DOUBLE) AS a{i}" for i in range(7))
    + ", 7 AS width FROM lineitem",
    "polynomial": """
        SELECT l_orderkey, l_partkey, x::FLOAT::DOUBLE AS x, (x * x)::FLOAT::DOUBLE AS xx, y::FLOAT::DOUBLE AS y,
               (x * y)::FLOAT::DOUBLE AS xy, (y * y)::FLOAT::DOUBLE AS yy, z::FLOAT::DOUBLE AS z,
               (x * z)::FLOAT::DOUBLE AS xz, (y * z)::FLOAT::DOUBLE AS yz, (z * z)::FLOAT::DOUBLE AS zz
        FROM (SELECT l_orderkey, l_partkey, l_quantity AS x, l_discount AS y, l_tax AS z FROM lineitem)""",
    "chi_square_scores": FLAGGED + " UNION ALL ".join(_chi_square(c) for c in ("l_linenumber", "l_quantity", "l_tax")),
    "chi_square": """
        SELECT l_orderkey, l_partkey, 1 AS width,
               CAST(CASE WHEN l_linenumber = 1 OR l_returnflag = 'A' THEN 0 WHEN l_returnflag = 'N' THEN 1 ELSE 2 END AS DOUBLE) AS selected
        FROM lineitem""",
    "svm_binary": f"SELECT CAST({IS_BIG} AS DOUBLE) AS prediction_result, CAST({IS_BIG} AS DOUBLE) AS is_big FROM lineitem",
    "svm_owlqn": f"SELECT CAST({IS_BIG} AS DOUBLE) AS prediction_result, CAST({IS_BIG} AS DOUBLE) AS is_big FROM lineitem",
    "gbt_binary": _by_frequency("CASE WHEN l_linenumber > 3 THEN 'late' ELSE 'early' END", "label",
        "CAST(l_linenumber AS DOUBLE) AS l_linenumber, round(l_discount, 6) AS l_discount, round(l_tax, 6) AS l_tax"),
    "lr_binary": f"""SELECT CAST({IS_BIG} AS DOUBLE) AS prediction, CAST({IS_BIG} AS DOUBLE) AS label,
        l_quantity - 25.5 AS above_middle, round(l_tax, 6) AS l_tax FROM lineitem""",
    "lr_multi": CLASSES,
    "mlp_multi": CLASSES,
    "rf_multi": _by_frequency("CASE WHEN l_quantity > 34 THEN 2 WHEN l_quantity > 17 THEN 1 ELSE 0 END", "CAST(label AS VARCHAR)",
        "l_quantity, round(l_discount, 6) AS l_discount"),
    "predict_by_ordinal": f"SELECT CAST({IS_BIG} AS DOUBLE) AS prediction_result FROM lineitem",
    "binary_metrics_hard": _curve(RULE[0], IS_BIG, IS_BIG),
    "binary_metrics_raw": _curve(*RULE),
    "multiclass_metrics": """
        WITH m AS (SELECT l_returnflag AS y, CASE WHEN l_quantity > 34 THEN 'A' WHEN l_quantity > 17 THEN 'N' ELSE 'R' END AS p FROM lineitem),
             k AS (SELECT c.y, c.n, coalesce(h.hit * 1.0 / h.n, 0) AS prec
                   FROM (SELECT y, count(*) AS n FROM m GROUP BY y) c
                   LEFT JOIN (SELECT p, count(*) AS n, sum(CASE WHEN y = p THEN 1 ELSE 0 END) AS hit FROM m GROUP BY p) h ON c.y = h.p)
        SELECT 'accuracy' AS metric, round(avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END), 8) AS value FROM m
        UNION ALL SELECT 'weighted_precision', round(sum(n * prec) / sum(n), 8) FROM k""",
    "evaluate_svm": _curve(NOISY, "l_quantity", IS_BIG),
    "evaluate_lr": _curve(NOISY, IS_BIG, IS_BIG),
    "evaluate_lr_raw": _curve(NOISY, "l_quantity", IS_BIG),
    "evaluate_forest": _curve(NOISY, IS_BIG, IS_BIG),
    "model_parameters": _report_rows(),
    "feature_importance": """
        SELECT 'l_linenumber' AS feature, CAST(1 AS DOUBLE) AS importance
        UNION ALL SELECT 'l_discount', CAST(0 AS DOUBLE)""",
    "lenient_features": """
        SELECT value, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS DOUBLE) AS k, CAST(0 AS DOUBLE) AS event_type FROM events""",
    "frequent_items": """
        WITH kinds AS (SELECT event_type, CAST(row_number() OVER (ORDER BY event_type) - 1 AS INTEGER) AS i
                       FROM (SELECT DISTINCT event_type FROM events)),
             baskets AS (SELECT bit_or(1 << i) AS mask FROM events JOIN kinds USING (event_type)
                         GROUP BY user_id, CAST(ts AS DATE)),
             totals AS (SELECT count(*) AS n, (SELECT count(*) FROM kinds) AS k FROM baskets),
             sets AS (SELECT unnest(range(1, 1 << CAST(k AS INTEGER))) AS s FROM totals),
             found AS (SELECT s, count(*) AS freq FROM sets JOIN baskets ON (mask & s) = s GROUP BY s)
        SELECT (SELECT string_agg(event_type, ',' ORDER BY event_type) FROM kinds WHERE ((s >> i) & 1) = 1) AS items, freq
        FROM found, totals WHERE freq >= ceil(0.05 * n)""",
    "frequent_sequences": """
        WITH steps AS (SELECT page_id, string_split(url, '/') AS s FROM pages),
             one AS (SELECT page_id, unnest(s) AS step, unnest(range(1, len(s) + 1)) AS i FROM steps),
             found AS (
                 SELECT DISTINCT page_id, step AS pattern FROM one
                 UNION ALL SELECT DISTINCT a.page_id, a.step || '>' || b.step FROM one a
                     JOIN one b ON a.page_id = b.page_id AND a.i < b.i
                 UNION ALL SELECT DISTINCT a.page_id, a.step || '>' || b.step || '>' || c.step FROM one a
                     JOIN one b ON a.page_id = b.page_id AND a.i < b.i
                     JOIN one c ON a.page_id = c.page_id AND b.i < c.i)
        SELECT pattern, count(*) AS freq FROM found GROUP BY pattern
        HAVING count(*) >= ceil(0.05 * (SELECT count(*) FROM pages))""",
    "flow_demo": FLOW,
    "flow_from_node": FLOW,
    "flow_evaluate": _curve(NOISY, "l_quantity", IS_BIG),
}
