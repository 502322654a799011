"""Research-corpus analytics on Spark: DataFrame and SQL operators, sources, sinks and streams."""

__version__ = "0.1.0"
