"""Lectern: reading-library analytics and corpus preparation as PySpark jobs."""
