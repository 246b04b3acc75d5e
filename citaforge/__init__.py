"""Citation verification and corpus processing on PySpark DataFrames."""
