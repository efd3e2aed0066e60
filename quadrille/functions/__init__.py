"""Column expressions for RDF terms."""
