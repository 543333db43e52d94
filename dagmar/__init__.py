"""dagmar: programs as data on PySpark."""
