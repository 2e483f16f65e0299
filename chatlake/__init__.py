"""Analytics over archives of conversations and notes, on Spark DataFrames."""
