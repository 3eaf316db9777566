"""Jobs put together from the operators, and the registry of queries."""
