"""An ordered, versioned key-value engine on Spark DataFrames."""
