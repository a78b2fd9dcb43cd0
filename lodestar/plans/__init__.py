"""Measures over time, each written as one plan."""
