"""Results on small tables: worked by hand, then against a nested-loop join."""

from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException

from weftline.plans.nation_revenue import nation_revenue

SCHEMAS = (
    "l_orderkey bigint, l_extendedprice double, l_discount double",
    "o_orderkey bigint, o_custkey bigint",
    "c_custkey bigint, c_nationkey int",
    "n_nationkey int, n_name string",
)


def run(spark, *tables):
    frames = (spark.createDataFrame(rows, schema) for rows, schema in zip(tables, SCHEMAS))
    return {row.n_name: (row.revenue, row.n_orders) for row in nation_revenue(*frames).collect()}


def brute_force(lines, orders, customers, nations):
    """Join row by row, then group."""
    groups = {}
    for order_key, price, discount in lines:
        for o_key, o_customer in orders:
            for c_key, c_nation in customers:
                for n_key, name in nations:
                    if None in (order_key, o_customer, c_nation):
                        continue
                    if (order_key, o_customer, c_nation) != (o_key, c_key, n_key):
                        continue
                    total, keys = groups.setdefault(name, ([], set()))
                    keys.add(order_key)
                    if price is not None and discount is not None:
                        total.append(Decimal(str(price)) * (1 - Decimal(str(discount))))
    return {
        name: (sum(total) if total else None, len(keys)) for name, (total, keys) in groups.items()
    }


def test_by_hand(spark):
    lines = [
        (1, 100.00, 0.10),  # 90
        (1, 0.01, 0.01),  # 0.0099
        (2, 50.00, 0.00),  # 50
        (3, 7.00, None),  # no amount, but order 3 counts
        (4, 9.00, 0.50),  # customer unknown
        (9, 1.00, 0.00),  # order unknown
        (None, 1.00, 0.00),
    ]
    orders = [(1, 10), (2, 11), (3, 12), (4, 99), (5, 10), (None, 10)]
    customers = [(10, 0), (11, 0), (12, 1), (13, None)]
    nations = [(0, "A"), (1, "B"), (2, "C")]
    assert run(spark, lines, orders, customers, nations) == {
        "A": (Decimal("140.0099"), 2),
        "B": (None, 1),
    }


def test_repeated_keys_multiply_revenue_but_not_orders(spark):
    # Order 1 appears twice for customer 10 and once for 11; both nations are named A.
    result = run(
        spark,
        [(1, 10.00, 0.00), (1, 1.00, 0.00)],
        [(1, 10), (1, 10), (1, 11)],
        [(10, 0), (11, 1)],
        [(0, "A"), (1, "A")],
    )
    assert result == {"A": (Decimal("33.0000"), 1)}


def test_empty_tables(spark):
    assert run(spark, [], [], [], []) == {}


@pytest.mark.parametrize("broadcast", ["10MB", "-1"])
def test_extreme_amounts_stay_exact(spark, conf, broadcast):
    conf("spark.sql.autoBroadcastJoinThreshold", broadcast)
    lines = [(1, 1e13, 0.0), (1, 0.01, 0.99), (1, -1e13, 0.0)] * 5
    result = run(spark, lines, [(1, 10)], [(10, 0)], [(0, "A")])
    assert result == {"A": (Decimal("0.0005"), 1)}


@pytest.mark.parametrize("ansi", ["true", "false"])
@pytest.mark.parametrize("amount", [1e17, float("nan"), float("inf"), -1e17])
def test_values_that_are_no_amounts_raise(spark, conf, ansi, amount):
    conf("spark.sql.ansi.enabled", ansi)
    with pytest.raises(PySparkException, match="no amount"):
        run(spark, [(1, amount, 0.0), (1, 5.0, 0.0)], [(1, 10)], [(10, 0)], [(0, "A")])


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_overflow_raises(spark, conf, ansi):
    conf("spark.sql.ansi.enabled", ansi)
    # A line of about 10**32: seven zeros below the limit of a sum, which repeated orders then pass.
    lines = [(1, 9e15, -9e15)] * 10
    with pytest.raises(PySparkException, match="(?i)overflow|out of range|cannot be represented"):
        run(spark, lines * 9, [(1, 10)] * 1_000, [(10, 0)] * 100, [(0, "A")])


def test_further_decimals_are_rounded_half_up(spark):
    lines = [(1, 1.005, 0.0), (1, 1.004, 0.004), (1, -1.005, 0.0)]
    assert run(spark, lines, [(1, 10)], [(10, 0)], [(0, "A")]) == {"A": (Decimal("1.0000"), 1)}


keys = st.one_of(st.none(), st.integers(0, 3))
cents = st.one_of(st.none(), st.integers(-1_000_000, 1_000_000).map(lambda n: n / 100))
hundredths = st.one_of(st.none(), st.integers(0, 100).map(lambda n: n / 100))


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.tuples(keys, cents, hundredths), max_size=12),
    st.lists(st.tuples(keys, keys), max_size=8),
    st.lists(st.tuples(keys, keys), max_size=6),
    st.lists(st.tuples(keys, st.sampled_from(["A", "B", None])), max_size=4),
)
def test_matches_brute_force(spark, lines, orders, customers, nations):
    assert run(spark, lines, orders, customers, nations) == brute_force(
        lines, orders, customers, nations
    )
