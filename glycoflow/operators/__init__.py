"""Table-to-table operators: builders, enrichment, joins, sequences, detectors, features."""
