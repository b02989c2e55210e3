"""Whole queries put together from operators, and their SQL twins."""
