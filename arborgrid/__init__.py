"""arborgrid: point clouds, surfaces and polygons as Spark DataFrames."""
