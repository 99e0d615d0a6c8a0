"""PySpark jobs that govern the SQL living inside application code."""

__version__ = "0.1.0"
