"""Column expressions, which run inside the JVM, and the helpers that run inside Python tasks."""
