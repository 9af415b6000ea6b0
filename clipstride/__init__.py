"""Highlight analytics on Spark: DataFrame in, DataFrame out, keyed by recording."""
