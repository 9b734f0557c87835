"""The queries that the driver runs, and SQL that says the same in another way."""
