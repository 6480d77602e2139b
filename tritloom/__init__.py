"""tritloom: sparse ternary vector analytics and training-data operators on Spark DataFrames."""
