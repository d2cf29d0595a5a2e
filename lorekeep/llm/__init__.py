"""Operators for building training data: sharding, similarity joins, filters, scoring, mixing, encoding.

Nothing outside this subpackage imports it.  Every operator module exposes a
general DataFrame-to-DataFrame function; :mod:`lorekeep.llm.queries` derives
the registered queries from those functions.
"""
