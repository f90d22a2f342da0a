"""Wearable and glucose analytics as lazy PySpark DataFrame jobs."""

from biotrace.schema import Tables

__all__ = ["Tables"]
