"""Media- and document-dataset analytics on Spark DataFrames."""
