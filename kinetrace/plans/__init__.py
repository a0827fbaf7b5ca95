"""The catalogue of queries over the provided tables."""
