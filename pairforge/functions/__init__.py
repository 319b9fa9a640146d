"""Column functions on arrays: distances, correlations, p-values."""
