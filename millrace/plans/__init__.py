"""Pipelines of steps."""
