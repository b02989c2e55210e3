"""Operators for preparing language-model training text.

Nothing else in the package imports this subpackage.  Each operator takes and returns DataFrames;
numpy and Arrow work only inside tasks, on one bounded batch, bucket or block at a time.
"""
