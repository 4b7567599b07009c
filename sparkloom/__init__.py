"""Document analytics written for PySpark DataFrames and Spark SQL."""
