"""Payment-session analytics as plain Spark DataFrame code."""
