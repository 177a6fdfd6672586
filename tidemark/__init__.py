"""tidemark: time-interval analytics and training-data operators on Spark DataFrames."""
