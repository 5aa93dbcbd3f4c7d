"""Operators for large-scale training-data pipelines.

Every operator takes a DataFrame plus column names and returns a DataFrame; the
registered ``opN_*`` queries in ``queries`` are thin views on them.  Nothing else in
the library imports this package.
"""
