"""A PySpark engine for query chains."""
