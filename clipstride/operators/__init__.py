"""Relational operators. Every one takes and returns DataFrames."""
