"""Spark batch jobs for timelines of video and language data."""
