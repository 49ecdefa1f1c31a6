"""Layout geometry analytics on Spark."""
