"""Document-corpus analytics as DataFrame operators on PySpark."""
