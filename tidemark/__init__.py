"""Time-decayed stream summaries and interval queries on Spark."""
