"""Column functions and aggregates."""
