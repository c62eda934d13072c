"""echoloom: duplicate-code analytics on Spark DataFrames."""
