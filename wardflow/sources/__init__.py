"""Readers: flow records, corpora, notebooks, requirement lists and tool documents."""
