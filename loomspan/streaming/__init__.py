"""Traces from a stream of ticks."""
