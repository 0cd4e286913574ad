"""Every registered query against its SQL, on whole tables."""

import datetime
import decimal
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import Row

import __spark_entry__ as contract
from weftline.sources import TABLES, read_table

SCALES = ("sf0.001", "sf0.01", "sf0.1")

#: Queries without SQL, and why.
WITHOUT_SQL = {
    "op3_prob_minhash": "signatures and components have no SQL; compared to all pairs in its tests",
    "op4_iblt": "its hashes have no SQL function in DuckDB; compared to plain sets in its tests",
    "op5_chaining": "chaining has no SQL; its tests hold the best chain to all pairs and search planted passages",
    "op6_best_fit": "tokens and packing have no SQL; compared to the tokenizer in its tests",
    "op10_bpe": "tokens have no SQL; compared to the tiktoken library in its tests",
    "op11_bit_packing": "tokens and files have no SQL; compared to the tokenizer in its tests",
    "op13_token_alignment": "tokens have no SQL; compared to a walk over the libraries' tokens in its tests",
    "pipeline": "holds stages without SQL; compared to plain versions in its tests",
}

# DuckDB's names of types, by Spark's.
SPARK_TYPES = {
    "varchar": "string",
    "integer": "int",
    "timestamp": "timestamp_ntz",
    "timestamp with time zone": "timestamp",
    "blob": "binary",
    "bigint": "bigint",
    "double": "double",
    "float": "float",
    "boolean": "boolean",
    "date": "date",
}


def spark_type(name):
    name = str(name).lower()
    if name.endswith("[]"):
        return f"array<{spark_type(name[:-2])}>"
    return name if name.startswith("decimal") else SPARK_TYPES[name]


def key(value):
    """Sorts rows with nulls, and makes equal what both engines return for a value."""
    if isinstance(value, (Row, tuple, list)):
        return (2, tuple(map(key, value)))
    if isinstance(value, dict):
        return (2, tuple((key(k), key(v)) for k, v in value.items()))
    if value is None:
        return (0, 0)
    if isinstance(value, (bytearray, bytes)):
        return (1, bytes(value).hex())
    if isinstance(value, float):
        return (1, repr(value))
    if isinstance(value, (datetime.date, decimal.Decimal, bool)):
        return (1, str(value))
    return (1, value)


def oracle(sf_dir, sql):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')"
        )
    result = connection.execute(sql)
    columns = [(column[0], spark_type(column[1])) for column in result.description]
    return columns, result.fetchall()


def test_every_query_has_sql_or_a_reason():
    queries, with_sql = set(contract.queries()), set(contract.oracle_sql())
    assert with_sql <= queries
    assert queries - with_sql <= set(WITHOUT_SQL)
    assert not with_sql & set(WITHOUT_SQL)


# The other queries are heavier, and their own tests cover larger and odder inputs.
CASES = [(name, scale) for name in sorted(contract.oracle_sql()) for scale in (SCALES if name == "nation_revenue" else SCALES[:1])]


@pytest.mark.parametrize("name, scale", CASES)
def test_query_matches_oracle(spark, name, scale):
    sf_dir = f"/root/testdata/{scale}"
    columns, expected = oracle(sf_dir, contract.oracle_sql()[name])
    actual = contract.queries()[name](spark, sf_dir)
    assert actual.columns == [column for column, _ in columns]
    assert [dtype for _, dtype in actual.dtypes] == [dtype for _, dtype in columns]
    assert sorted(map(key, actual.collect())) == sorted(map(key, expected))
    assert expected


def test_comparison_takes_nulls_arrays_and_times(spark):
    sql = "SELECT * FROM VALUES (1, array('a', NULL), timestamp_ntz'2024-01-01 00:00:00', 1.5D), (NULL, NULL, NULL, NULL) t(a, b, c, d)"
    rows = spark.sql(sql)
    duck = duckdb.sql("SELECT * FROM (VALUES (1, ['a', NULL], TIMESTAMP '2024-01-01', 1.5::DOUBLE), (NULL, NULL, NULL, NULL)) t(a, b, c, d)")
    assert [spark_type(t) for t in duck.types] == [t for _, t in rows.dtypes]
    assert sorted(map(key, rows.collect())) == sorted(map(key, duck.fetchall()))
    assert sorted(map(key, rows.collect())) != sorted(map(key, duck.filter("a IS NULL").fetchall()))


def test_entry(spark):
    result = contract.entry(spark)
    assert result.dtypes == [
        ("n_name", "string"),
        ("revenue", "decimal(38,4)"),
        ("n_orders", "bigint"),
    ]
    assert result.count() == 25


def test_unknown_table(spark):
    with pytest.raises(ValueError, match="unknown table 'invoices'"):
        read_table(spark, "/root/testdata/sf0.001", "invoices")


def test_entry_imports_without_the_llm_modules(tmp_path):
    root = Path(contract.__file__).resolve().parent
    for kept in ("nothing", "an empty folder", "the pipeline"):
        copy = tmp_path / kept
        shutil.copytree(root / "weftline", copy / "weftline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
        shutil.copy(root / "__spark_entry__.py", copy)
        if kept == "an empty folder":
            (copy / "weftline" / "llm" / "__pycache__").mkdir(parents=True)
        if kept != "nothing" and (root / "corpus_pipeline.py").exists():
            shutil.copy(root / "corpus_pipeline.py", copy)
        code = "import __spark_entry__ as e; assert set(e.queries()) == set(e.oracle_sql()) == {'nation_revenue'}"
        subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={**os.environ, "PYTHONPATH": str(copy)})
