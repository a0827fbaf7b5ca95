"""Recorded datasets as DataFrames: metadata, stream catalogue, readings, frames."""
