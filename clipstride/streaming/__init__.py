"""Structured Streaming forms of the operators that watch live recordings and workers."""
