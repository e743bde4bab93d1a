"""A PySpark-native engine for image-reconstruction benchmarking over DataFrames."""
