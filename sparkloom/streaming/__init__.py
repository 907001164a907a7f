"""Structured Streaming forms of the study log operators (an extension)."""
