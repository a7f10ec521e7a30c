"""Time-frequency stream analytics on Spark."""
