"""Protocol Buffers data and large text corpora in PySpark DataFrames."""
