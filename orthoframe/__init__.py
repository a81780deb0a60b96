"""Dense aerial reconstruction and corpus analytics on Spark DataFrames."""
