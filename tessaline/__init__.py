"""tessaline: a Spark-first analytics engine for timestamped text records, their vectors and their entity graph."""

__version__ = "0.1.0"
