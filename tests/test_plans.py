"""Plan shape, with broadcast off as on tables too large for it."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from weftline.plans.nation_revenue import nation_revenue
from weftline.sources import read_table

SF_DIR = "/root/testdata/sf0.01"
INPUTS = ("lineitem", "orders", "customer", "nation")


def explained(frame, capsys, mode="simple"):
    capsys.readouterr()
    frame.explain(mode)
    return capsys.readouterr().out


def final_plan(text):
    return text.split("== Initial Plan ==")[0]


@pytest.fixture
def tables(spark):
    return {name: read_table(spark, SF_DIR, name) for name in INPUTS}


def test_scans_read_only_needed_columns(spark, capsys):
    text = explained(contract.queries()["nation_revenue"](spark, SF_DIR), capsys)
    assert sorted(re.findall(r"ReadSchema: struct<(.*?)>", text)) == [
        "c_custkey:bigint,c_nationkey:int",
        "l_orderkey:bigint,l_extendedprice:double,l_discount:double",
        "n_nationkey:int,n_name:string",
        "o_orderkey:bigint,o_custkey:bigint",
    ]
    assert "IsNotNull(l_orderkey)" in text
    assert "CartesianProduct" not in text and "NestedLoop" not in text and "Python" not in text


def test_large_tables_sort_merge_and_lines_shuffle_once(spark, conf, capsys):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.adaptive.enabled", "false")
    text = explained(contract.queries()["nation_revenue"](spark, SF_DIR), capsys)
    assert "Broadcast" not in text
    assert text.count("SortMergeJoin") == 3
    lines = re.findall(r"Exchange hashpartitioning\(l_orderkey#\d+L, \d+\).*\n.*", text)
    assert len(lines) == 1
    assert "partial_sum" in lines[0]
    # Orders move for the customer join, for the count per (order, nation) after it, and for the lines.
    keys = [re.sub(r"#\d+L?", "", key) for key in re.findall(r"Exchange hashpartitioning\((.*), \d+\)", text)]
    assert sorted(keys) == sorted(
        ["l_orderkey", "o_custkey", "o_orderkey, n_name", "o_orderkey", "c_custkey", "c_nationkey", "n_nationkey", "n_name"]
    )


@pytest.mark.parametrize("table, key, value", [
    ("lineitem", "l_orderkey", 5),
    ("orders", "o_custkey", 7),
    ("orders", "o_orderkey", 5),
])
def test_hot_key_gives_the_same_answer_as_sql(spark, conf, tables, table, key, value):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    frame = tables[table]
    hot = F.xxhash64(*frame.columns) % 3 == 0
    tables[table] = frame.withColumn(key, F.when(hot, F.lit(value).cast("bigint")).otherwise(F.col(key)))
    expected = spark.sql(
        contract.oracle_sql()["nation_revenue"].replace("lineitem\n", "{lineitem}\n")
        .replace("JOIN orders", "JOIN {orders}")
        .replace("JOIN customer", "JOIN {customer}")
        .replace("JOIN nation", "JOIN {nation}"),
        **tables,
    )
    actual = nation_revenue(*(tables[name] for name in INPUTS))
    assert sorted(actual.collect()) == sorted(expected.collect())


def test_hot_customer_is_split(spark, conf, capsys, tables):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16KB")
    conf("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "16KB")
    conf("spark.sql.adaptive.skewJoin.skewedPartitionFactor", "2")
    tables["orders"] = (
        tables["orders"]
        .withColumn("o_custkey", F.when(F.col("o_orderkey") % 3 == 0, F.lit(7).cast("bigint")).otherwise(F.col("o_custkey")))
        .repartition(16)
    )
    result = nation_revenue(*(tables[name] for name in INPUTS))
    result.collect()
    text = final_plan(explained(result, capsys))
    assert re.search(r"SortMergeJoin\(skew=true\) \[o_custkey", text)


def test_hot_order_is_combined_before_the_shuffle(spark, conf, capsys, tables):
    """A third of the lines on one order must not make its join partition the large one."""
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16KB")
    conf("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "16KB")
    conf("spark.sql.adaptive.skewJoin.skewedPartitionFactor", "2")
    conf("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    order_nation = tables["orders"].select("o_orderkey")
    hot = F.xxhash64("l_orderkey", "l_partkey") % 3 == 0
    lines = (
        tables["lineitem"]
        .withColumn("l_orderkey", F.when(hot, F.lit(5).cast("bigint")).otherwise(F.col("l_orderkey")))
        .repartition(16)
    )
    assert lines.filter("l_orderkey = 5").count() > 10_000

    # Control: joined unsummed, the same lines are seen as skewed.
    raw = lines.join(order_nation, F.col("l_orderkey") == F.col("o_orderkey"))
    raw = raw.groupBy("l_linestatus").agg(F.sum("l_extendedprice"), F.sum("l_discount"))
    raw.collect()
    assert "SortMergeJoin(skew=true)" in final_plan(explained(raw, capsys))

    tables["lineitem"] = lines
    result = nation_revenue(*(tables[name] for name in INPUTS))
    result.collect()
    text = final_plan(explained(result, capsys))
    assert re.search(r"SortMergeJoin \[o_orderkey", text)
