"""cubeframe: hyperspectral cubes, their labels and their text corpora as Spark DataFrames."""
