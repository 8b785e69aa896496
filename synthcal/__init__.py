"""Confidence intervals from real and synthetic measurements, as Spark jobs."""
