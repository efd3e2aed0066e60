"""Readers of RDF texts, relational tables as virtual triples, and a generator."""
