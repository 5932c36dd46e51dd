"""Self-configuring analytics over arbitrary tables, on Spark."""
