"""spanloom: span-annotated dialogue analytics on Spark DataFrames."""
