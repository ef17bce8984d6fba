"""Tick analytics, statistical discovery and governance ledgers as Spark jobs."""
