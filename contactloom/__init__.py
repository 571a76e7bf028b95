"""Contact-map analytics on Spark."""
