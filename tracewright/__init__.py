"""Agent-trace analytics as Spark DataFrame jobs."""
