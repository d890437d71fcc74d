"""Operators for preparing training data.

Nothing outside this subpackage imports it.  Each module holds one operator
with a general interface; ``queries`` registers the thin ``opN_<name>`` queries.
"""
