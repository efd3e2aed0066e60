"""Joins of solution mappings, the quad store and RDFS entailment."""
