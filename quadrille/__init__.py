"""quadrille: RDF graphs and SPARQL on Spark DataFrames."""
