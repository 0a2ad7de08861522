"""Operators over instance tables: blocks, references, timeline, packing."""
