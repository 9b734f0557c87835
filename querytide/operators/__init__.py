"""DataFrame operators: filters, counts, rankings."""
