"""tessera: similarity graphs over sparse feature bags, on Spark DataFrames."""
