"""Column expressions and the few numeric helpers Spark has no function for."""
