"""Spark jobs for a raw -> bronze -> silver -> gold data lake."""
