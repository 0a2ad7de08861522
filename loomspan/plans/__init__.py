"""Shapes, and the registered queries of the trace engine."""
