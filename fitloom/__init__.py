"""fitloom: talent-matching analytics as plain Spark DataFrame jobs."""
