"""A PySpark analytics engine for star-schema data: profiling, cleaning, validation, measures and filing text."""
