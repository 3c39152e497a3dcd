"""Typed table reads, nested-document flattening, feeds and sinks."""
