"""Analyses over the roll-call model: DataFrames in, DataFrames out, all terms at once."""
