"""Waymark: features, profiles, ranked predictions and scores as Spark jobs."""

__version__ = "0.1.0"
