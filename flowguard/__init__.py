"""Network-threat analytics on Spark DataFrames: batch and streaming share every operator."""
