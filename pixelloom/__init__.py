"""pixelloom: raster analytics and corpus preparation on Spark DataFrames."""
