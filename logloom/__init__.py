"""Log analytics and corpus preparation on PySpark."""
