"""Graph neural network computation and corpus preparation on Spark DataFrames."""
