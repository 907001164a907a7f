"""Queries over the standard tables, each with equivalent SQL."""
