"""Trajectory and state-sequence analytics on Spark."""
