"""Training-data operators: one module per operator, one registry of queries."""
