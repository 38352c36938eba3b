"""Change-log analytics on PySpark."""
