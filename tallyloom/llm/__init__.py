"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Each numbered operator lives in a
module of its own; ``queries`` binds them to the given tables.
"""
