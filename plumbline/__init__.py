"""Spark jobs for detecting and investigating interference in satellite timing data."""
