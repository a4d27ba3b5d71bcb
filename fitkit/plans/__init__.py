"""Trainers: each one is a short driver loop over Spark jobs."""
