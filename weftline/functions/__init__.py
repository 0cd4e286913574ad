"""Column expressions shared by queries."""

from weftline.functions.money import exact_product, exact_sum, money

__all__ = ["exact_product", "exact_sum", "money"]
