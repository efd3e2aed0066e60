"""SPARQL text to algebra to Spark plans."""
