"""A retrieval and text-analytics engine on PySpark."""
