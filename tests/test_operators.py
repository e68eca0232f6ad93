import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from larkspur.functions.types import EngineError, TypeMismatch, schema
from larkspur.operators import aggregate, hash_join, range_selection, relational, selection, sort, sort_merge_join, sorted_rows
from larkspur.queries import QUERIES


@pytest.fixture(scope="module")
def suppliers(spark):
    left = spark.range(200).selectExpr("cast(id as int) l_k", "concat('S', lpad(id, 4, '0')) l_name", "cast(id % 25 as int) l_nation", "id * 1.5D - 40 l_bal")
    right = spark.range(200).selectExpr("cast(id as int) r_k", "concat('S', lpad(id, 4, '0')) r_name", "cast(id % 25 as int) r_nation", "id * 1.5D - 40 r_bal")
    return left, right.withColumn("c", __import__("pyspark").sql.functions.expr("explode(sequence(1, 32))")).drop("c")


def shown(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("strategy", ["hash", "broadcast", "auto", "merge"])
def test_join_strategies_agree_and_show_in_the_plan(suppliers, strategy):
    left, right = suppliers
    args = {"where": "!= ([l_bal], int[-40])", "projections": ["[l_name]", "+ ([l_bal], [r_bal])"], "left_where": "|| (== ([l_nation], int[3]), == ([l_nation], int[4]))", "right_where": "== ([r_nation], int[3])"}
    if strategy == "merge":
        out = sort_merge_join(left, right, ("[l_name]", "[r_name]"), **args)
    else:
        out = hash_join(left, right, [("[l_name]", "[r_name]"), ("[l_k]", "[r_k]")], strategy=strategy, **args)
    node = {"hash": "ShuffledHashJoin", "broadcast": "BroadcastHashJoin", "merge": "SortMergeJoin"}.get(strategy)
    assert node is None or node in shown(out)
    got = aggregate(out, [("cnt", "int[0]")], ["[l_name]"]).collect()
    assert len(got) == 8 and {r["cnt"] for r in got} == {32}


def test_broadcast_only_of_a_checked_size(suppliers):
    left, right = suppliers
    assert "BroadcastHashJoin" not in shown(hash_join(left, right, [("[l_k]", "[r_k]")], strategy="broadcast", max_broadcast_rows=199)).split("== Physical Plan ==")[1]


@pytest.mark.parametrize("most", [100_000, 0])
@pytest.mark.parametrize("swap", [False, True])
def test_join_of_many_to_many_deals_out_keys_of_many_pairs(spark, monkeypatch, swap, most):
    monkeypatch.setattr(relational, "LEAST_PAIRS", 500)
    monkeypatch.setattr(relational, "MOST_PAIRS", 500)
    # one key with most pairs, exact copies, keys of few pairs, of one side alone and null; -0.0 equals 0.0 and NaN itself
    left = spark.sql("select l_k, id l_id from (values (1.0D, 60), (2.0D, 3), (-0.0D, 40), (double('nan'), 30), (4.0D, 5), (null, 7)) v(l_k, n) lateral view explode(sequence(1, n)) e as id")
    right = spark.sql("select r_k, 1 r_id, 'x' r_x from (values (1.0D, 900), (2.0D, 30), (0.0D, 50), (double('nan'), 45), (5.0D, 5), (null, 70)) v(r_k, n) lateral view explode(sequence(1, n)) e as id").coalesce(1)
    if swap:
        left, right, keys = right, left, [("[r_k]", "[l_k]")]
    else:
        keys = [("[l_k]", "[r_k]")]
    out = hash_join(left, right, keys, strategy="many", max_broadcast_rows=most)
    assert out.columns == left.columns + right.columns
    count = lambda df: Counter((str(abs(r["l_k"])), str(abs(r["r_k"])), r["l_id"], r["r_x"]) for r in df.collect())
    found = count(out)
    assert sum(found.values()) == 60 * 900 + 3 * 30 + 40 * 50 + 30 * 45 and found == count(hash_join(left, right, keys))
    if most:
        made = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert len(made) > 100 and max(made) < 1000
    assert hash_join(left.limit(0), right, keys, strategy="many", max_broadcast_rows=most).collect() == []


def test_join_many_to_many_of_one_file_is_no_single_task(spark, tmp_path):
    for name, n in (("s", 2000), ("c", 15_000)):
        spark.range(n).selectExpr("cast(id % 5 as int) k", "concat('N', id) x").toDF(f"{name}_nationkey", f"{name}_name").coalesce(1).write.parquet(f"{tmp_path}/{dict(s='supplier', c='customer')[name]}.parquet")
    made = [r["count"] for r in QUERIES["join_many_to_many"](spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(made) == 2000 * 15_000 // 5 and max(made) <= sum(made) / 8


def test_join_faults(suppliers):
    left, right = suppliers
    for keys, error in (([], EngineError), ([("[l_name]", "[r_k]")], TypeMismatch)):
        with pytest.raises(error):
            hash_join(left, right, keys)
    with pytest.raises(EngineError, match="both sides"):
        hash_join(left, left, [("[l_k]", "[l_k]")])


def test_range_queries_on_seeded_ranges(suppliers):
    _, right = suppliers
    for seed in range(10):
        r = random.Random(seed)
        low, high = sorted((r.randrange(200), r.randrange(200)))
        got = [x["r_k"] for x in range_selection(right, "r_k", low, high, ordered=bool(seed % 2)).collect()]
        assert len(got) == 32 * (high - low + 1)
        assert not seed % 2 or got == sorted(got)
    assert range_selection(right, "r_k", 500, 900).collect() == []
    with pytest.raises(TypeMismatch):
        range_selection(right, "r_name", 1, 2)


def test_filters_and_columns_reach_the_scan(spark):
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    out = aggregate(lines, [("sum", "[l_extendedprice]")], ["[l_linestatus]"], "&& (== ([l_returnflag], string[A]), < ([l_quantity], double[24.0]))")
    plan = shown(out)
    assert "EqualTo(l_returnflag,A)" in plan and "LessThan(l_quantity,24.0)" in plan
    assert "ReadSchema: struct<l_quantity:double,l_extendedprice:double,l_returnflag:string,l_linestatus:string>" in plan
    ranged = range_selection(spark.read.parquet("/root/testdata/sf0.001/orders.parquet"), "o_orderkey", 5, 9)
    assert "GreaterThanOrEqual(o_orderkey,5)" in shown(ranged)


def test_aggregates(suppliers):
    left, _ = suppliers
    out = aggregate(left, [("cnt", "int[0]"), ("sum", "[l_k]"), ("avg", "[l_k]")], ["/ ([l_k], int[100])"], schema=schema(("band", "int"), ("n", "int"), ("total", "long"), ("mean", "double")))
    assert sorted(map(tuple, out.collect())) == [(0, 100, 4950, 49.5), (1, 100, 14950, 149.5)]
    assert [tuple(r) for r in aggregate(left, [("cnt", "int[0]"), ("sum", "[l_k]"), ("avg", "[l_bal]")], where="bool[no]").collect()] == [(0, None, None)]
    assert aggregate(left, [("cnt", "int[0]")], ["[l_k]"], "bool[no]").collect() == []
    with pytest.raises(TypeMismatch):
        aggregate(left, [("sum", "[l_name]")])
    with pytest.raises(EngineError):
        aggregate(left, [("max", "[l_k]")])


def test_sorts(suppliers):
    left, _ = suppliers
    keys = [r["l_bal"] for r in sort(left, "um ([l_bal])", "> ([l_k], int[10])").collect()]
    assert keys == sorted(keys, reverse=True) and len(keys) == 189
    assert [r["l_k"] for r in sorted_rows(left, "[l_k]")] == list(range(200))
    assert list(sorted_rows(left, "[l_k]", "bool[no]")) == []


def test_schemas_must_fit(suppliers):
    left, _ = suppliers
    with pytest.raises(EngineError):
        selection(left, projections=["[l_k]"], schema=schema(("a", "int"), ("b", "int")))
    with pytest.raises(TypeMismatch):
        selection(left, projections=["[l_name]"], schema=schema(("a", "int")))
    with pytest.raises(TypeMismatch):
        selection(left, "[l_k]")


def test_streams_take_the_same_operators(spark, tmp_path):
    from larkspur import streaming

    spark.range(100).selectExpr("id k").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("k long").parquet(str(tmp_path / "in"))
    out = streaming.aggregate(streaming.selection(source, "< ([k], int[10])"), [("sum", "[k]"), ("cnt", "int[0]")])
    q = out.writeStream.format("memory").queryName("sums").outputMode("complete").start()
    try:
        q.processAllAvailable()
        assert [tuple(r) for r in spark.table("sums").collect()] == [(45, 10)]
    finally:
        q.stop()
