"""Transcript reconciliation, audit, scoring and signal levelling as Spark jobs."""
