"""Document-layout analytics on Spark DataFrames: words, lines, regions, tables, forms, routing and verification."""
