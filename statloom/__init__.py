"""Analytics over per-subject event histories, as PySpark DataFrame operations."""
