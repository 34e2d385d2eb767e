"""Operators for building large-scale training corpora, one module each.

Nothing outside this package imports it; ``queries.py`` holds the thin queries
that apply each operator to the test tables.
"""
