"""tessellum: tagged-document, exposure, graph and quality queries as Spark DataFrames."""
