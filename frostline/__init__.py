"""Cold-chain telemetry analytics as Spark DataFrame operations."""
