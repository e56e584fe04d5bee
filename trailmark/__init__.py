"""Trailmark: a Spark-first engine for frame-ordered observation data."""

__version__ = "0.1.0"
