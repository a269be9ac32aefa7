"""A DataFrame-first analytics engine on PySpark."""
