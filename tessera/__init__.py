"""A PySpark engine for auditing, featurising and benchmarking large corpora."""
