"""Spark jobs for station and grid climate data."""
