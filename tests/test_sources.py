"""Reading, writing, previews and listings."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tablewright.operators import order_statistics, training
from tablewright.operators.mining import frequent_itemsets, frequent_sequences
from tablewright.sources import layout, tables
from tablewright.sources.scratch import scratch_folder, scratch_path


@pytest.mark.parametrize("format", ["csv", "json", "parquet", "orc"])
def test_round_trip(spark, orders, tmp_path, format):
    part = orders.select("o_orderkey", "o_totalprice", "o_orderpriority")
    path = tables.write_table(part, str(tmp_path / "out"), format=format)
    back = tables.read_table(spark, path, format=format, schema=None if format != "json" else part.schema)
    again = back.select(F.col("o_orderkey").cast("long"), "o_totalprice", "o_orderpriority")
    assert again.exceptAll(part).count() == 0 and again.count() == part.count()
    with pytest.raises(ValueError):
        tables.write_table(part, str(tmp_path / "other"), format="xls")


def test_csv_options(spark, tmp_path):
    path = str(tmp_path / "a.csv")
    with open(path, "w", encoding="utf-8") as file:
        file.write("名称,n\nx,1\ny,\n")
    assert dict(tables.read_table(spark, path).dtypes) == {"名称": "string", "n": "int"}
    assert dict(tables.read_table(spark, path, infer=False).dtypes)["n"] == "string"
    assert tables.read_table(spark, path, header=False).columns == ["_c0", "_c1"]
    assert dict(tables.read_table(spark, path, schema="a string, b double").dtypes)["b"] == "double"


def test_text_length(spark, tmp_path):
    path = tmp_path / "t.txt"
    path.write_text("ab\n\n中文c\n", encoding="utf-8")
    assert tables.read_text_length(spark, str(path)).head()["total_length"] == 5
    assert tables.text_length(spark.createDataFrame([], "value string")).head()["total_length"] == 0


def test_preview(orders, monkeypatch):
    df = orders.select("o_orderkey", "o_totalprice").repartition(6)
    expected = [tuple(r) for r in df.orderBy("o_orderkey").collect()]
    page = lambda: [tuple(r) for r in tables.preview(df, 700, 750, order_by="o_orderkey").collect()]
    assert page() == expected[700:750]
    for name, value in (("FETCHED", 5), ("SAMPLE", 40), ("PIVOTS", 7)):  # many rounds of the search
        monkeypatch.setattr(order_statistics, name, value)
    assert page() == expected[700:750]
    whole = tables.preview_page(df, 1490, 10**6, order_by="o_orderkey")
    assert whole.length == len(expected) and whole.rows.count() == len(expected) - 1490
    for start, end in ((5, 4), (-1, 4)):
        with pytest.raises(ValueError):
            tables.preview(df, start, end, order_by="o_orderkey")
    with pytest.raises(ValueError):
        tables.preview_page(df, 10**6, 10**7, order_by="o_orderkey")


def test_head_json_drops_null_fields(gaps):
    page = tables.head_page(gaps.select("i", "s"))
    assert page.length == 3
    assert [json.loads(r["json"]) for r in page.rows.collect()] == [{"i": 1, "s": "2019/3/25"}, {"i": 2, "s": "2019/3"}, {}]


def test_column_listing(spark, gaps):
    df = gaps.withColumn("b", F.lit(True)).withColumn("t", F.lit("7"))
    found = {r["column"]: (r["is_numeric"], r["non_null"], r["numeric_values"]) for r in tables.column_listing(df).collect()}
    assert found == {"i": (True, 2, 2), "d": (True, 2, 1), "s": (False, 2, 0), "b": (False, 3, 0), "t": (False, 3, 3)}
    assert [r["column"] for r in tables.column_listing(df, numeric_only=True).collect()] == ["i", "d"]
    assert tables.column_listing(df.select("s"), numeric_only=True).count() == 0


def test_scratch_follows_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert named is None or scratch_folder(spark) == named
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_spreading_never_lowers_partitions(spark, orders):
    """No switch by size: few partitions are raised to the cores, many stay as they are."""
    cores = spark.sparkContext.defaultParallelism
    assert layout.spread(orders).rdd.getNumPartitions() == cores
    many = orders.repartition(64)
    assert layout.spread(many) is many
    exploded = many.withColumn("x", F.explode(F.sequence(F.lit(1), F.lit(20))))
    with layout.held(exploded) as kept:
        assert kept.is_cached and kept.rdd.getNumPartitions() == 64


def test_large_partitions_of_wide_rows_are_dealt_out(spark, orders):
    """F3 to F6: a task went over as many rows as a file's split held, whatever a row took in the trainer."""
    rows, cores = orders.count(), spark.sparkContext.defaultParallelism
    parts = orders.repartition(cores)
    assert layout.spread(parts, layout.PART_BYTES // rows) is parts
    row_bytes = 40 * layout.PART_BYTES // rows
    with layout.held(parts, row_bytes) as kept:
        sizes = [r["count"] for r in kept.groupBy(F.spark_partition_id().alias("part")).count().collect()]
        assert sum(sizes) == rows and max(sizes) * row_bytes <= 1.2 * layout.PART_BYTES


@pytest.mark.parametrize("kind", ["forest", "gbt"])
def test_tree_trainers_bound_what_a_task_reads(spark, items, monkeypatch, kind):
    seen = []
    spread = layout.spread
    monkeypatch.setattr(layout, "PART_BYTES", 100_000)
    monkeypatch.setattr(layout, "spread", lambda df, row_bytes=None: seen.append(spread(df, row_bytes)) or seen[-1])
    df = items.withColumn("y", F.when(F.col("l_quantity") > 25, "big").otherwise("small"))
    if kind == "forest":
        training.train_forest(df, "y", ["l_quantity"], num_trees=50, max_depth=1, seed=1)
    else:
        training.train_gbt(df, "y", ["l_quantity"], iterations=1, max_depth=1, seed=1)
    least = df.count() * (330 if kind == "forest" else 250) / 100_000
    assert seen[0].rdd.getNumPartitions() >= least


def test_held_passes_see_the_same_rows(spark, orders):
    with layout.held(orders.select(F.rand().alias("x"))) as kept:
        assert kept.agg(F.sum("x")).first() == kept.agg(F.sum("x")).first()


def test_folders_are_read_by_their_files(spark, orders, tmp_path):
    path = f"{tmp_path}/folder"
    orders.write.parquet(path)
    assert tables.read_table(spark, path).columns == orders.columns
    (tmp_path / "odd").mkdir()
    (tmp_path / "odd" / "x.bin").write_text("1")
    with pytest.raises(ValueError):
        tables.read_table(spark, f"{tmp_path}/odd")


def test_mining_fixtures(spark):
    baskets = ["A B C E F O", "A C G", "E I", "A C D E G", "A C E G L", "E J", "A B C E F P", "A C D", "A C E G M", "A C E G N"]
    df = spark.createDataFrame([(b.split(),) for b in baskets], "items array<string>")
    found = {tuple(r["items"]): r["freq"] for r in frequent_itemsets(df, "items", min_support=0.3, num_partitions=2).collect()}
    assert len(found) == 15 and found[("A", "C")] == 8 and found[("E",)] == 8
    sequences = [["a", "abc", "ac", "d", "cf"], ["ad", "c", "bc", "ae"], ["ef", "ab", "df", "c", "b"], ["e", "g", "af", "c", "b", "c"]]
    df = spark.createDataFrame([([list(s) for s in row],) for row in sequences], "sequence array<array<string>>")
    assert frequent_sequences(df, "sequence", min_support=0.5, max_pattern_length=4).count() == 53
