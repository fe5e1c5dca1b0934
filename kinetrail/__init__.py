"""Trajectory, interval and event analytics as Spark DataFrame operators."""
