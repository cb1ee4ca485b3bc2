"""Agent-work telemetry, code-change outcomes and training-data operators as Spark DataFrame jobs."""
