"""Operators of a training-data pipeline: token files, mixing, near-duplicates, language models, packing, cleaning.

Nothing outside this subpackage imports it. ``queries`` holds the registered queries and their SQL.
"""
