"""Operators for preparing language-model training data with Spark.

Nothing else in the library imports this subpackage.  Every operator takes the
names of the id and text columns, reads only those, and so ignores extra
columns whatever they are called.
"""
