"""Sluice: market-flow and event-intelligence analytics as PySpark DataFrame jobs."""
