"""Structured Streaming forms of binning, sessions and exponential smoothing."""
