"""Training-data operators: text, token and vector work on DataFrames.

Each operator module has a general entry point over a DataFrame; ``queries``
holds the thin registered queries and their DuckDB SQL.
"""
