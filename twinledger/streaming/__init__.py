"""Structured Streaming: file drops and duplicate windows."""
