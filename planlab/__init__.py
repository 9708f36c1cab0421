"""planlab: workload analytics on PySpark DataFrames."""
