"""The expression language: typed values and casts."""
