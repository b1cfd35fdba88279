"""Queries over the engine's operators, and the dialects their SQL is rendered in."""
