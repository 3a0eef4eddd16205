"""gridlake: labelled, gridded (raster) data as Spark DataFrames, one row per cell."""
