"""Settlement analytics on Spark."""
