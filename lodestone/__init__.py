"""A PySpark-native analytics engine: operators, functions, sources, streams and plans on DataFrames."""
