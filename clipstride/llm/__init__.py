"""Operators of a training-data pipeline, one module each; ``catalog`` registers their queries."""
