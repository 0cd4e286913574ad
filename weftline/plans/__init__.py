"""Whole queries, built from the tables they are given."""
