"""brackenlake: retrieval, code-structure and corpus analytics on PySpark DataFrames."""
