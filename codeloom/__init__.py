"""Dependency-structure analytics and training-data operators as Spark jobs."""
