"""Episodic trajectory analytics on Spark."""

from .dataset import Camera, Dataset, Sample

__all__ = ["Camera", "Dataset", "Sample"]
