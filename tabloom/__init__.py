"""Table operators for cleaning, enriching and matching data on Spark."""

__version__ = "0.1.0"
