"""Column expressions: time, metrics, sequences."""
