"""loomwork: batch, streaming and machine-learning analytics on PySpark DataFrames."""
