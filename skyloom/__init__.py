"""skyloom: particle-snapshot and corpus analytics expressed on Spark DataFrames."""
