"""Graph operators: lookups, neighbours, closures and metrics as DataFrames."""
