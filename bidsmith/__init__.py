"""Award-signal analytics on PySpark: declarative operators, sources, plans and streams."""
