"""Event-time trade-flow analytics on PySpark DataFrames."""
