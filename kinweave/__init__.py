"""Entity resolution over document collections, on Spark DataFrames."""
