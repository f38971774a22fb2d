"""Training-data operators. Nothing else in the package imports this one.

Every module takes DataFrames and returns DataFrames. `queries.py` holds the
thin `opN_*` queries and their SQL.
"""
