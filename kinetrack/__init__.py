"""Multi-rate, multi-clock recording analytics as Spark DataFrame operators."""
