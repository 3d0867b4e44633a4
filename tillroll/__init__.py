"""Order processing over append-only transaction logs, written as Spark jobs."""
