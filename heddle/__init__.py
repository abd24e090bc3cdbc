"""heddle: dataset analytics operators expressed on Spark DataFrames."""
