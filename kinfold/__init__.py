"""kinfold: record linkage on Spark DataFrames."""
