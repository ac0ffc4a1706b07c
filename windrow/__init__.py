"""Windowed behavioural features over event data, and the checks that watch them, as Spark jobs."""
