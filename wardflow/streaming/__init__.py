"""Decisions on a stream of scored flows."""
