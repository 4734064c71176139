"""Operators of a training-data pipeline (dedup, extraction, filters, mixing).

Each module holds one operator with a general interface; ``queries`` applies
them to the given tables. Nothing outside this subpackage imports it.
"""
