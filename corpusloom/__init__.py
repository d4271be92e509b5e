"""Analytics over multi-repository code corpora as Spark DataFrames."""
