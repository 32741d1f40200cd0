"""tidemark: time-series signal research and training-data operators on Spark DataFrames."""
