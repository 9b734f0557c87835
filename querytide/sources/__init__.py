"""Reading messages and tables, writing results."""
