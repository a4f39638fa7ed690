"""corpusloom: training-data analytics on Spark DataFrames."""
