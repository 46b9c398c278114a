"""Whole plans: column roles on the given tables and the registered queries."""
