"""Messy business tables to clean, typed, queryable ones, on Spark."""
