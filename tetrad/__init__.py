"""Graph and temporal analytics on PySpark."""
