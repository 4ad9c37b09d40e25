"""grainmill: data preparation operators on Spark DataFrames."""
