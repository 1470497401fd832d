"""Player-and-ball tracking analytics on Spark."""
