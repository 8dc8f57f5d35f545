"""courtspark: sports-analytics features, scoring and odds as Spark DataFrame operators."""

__version__ = "0.1.0"
