"""A Spark-first engine for event-driven control data."""
