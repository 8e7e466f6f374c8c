"""Trace sources: files, framing, and a projector for each runtime."""
