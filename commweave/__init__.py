"""Graph-community analytics on PySpark DataFrames."""
