"""Operators for building language-model training data.

Nothing outside this subpackage imports it; ``queries.py`` holds the entries
that ``__spark_entry__`` picks up when the subpackage is present.
"""
