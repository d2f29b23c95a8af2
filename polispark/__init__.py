"""polispark: analytics over civic-accountability data, written for Spark's DataFrame engine."""
