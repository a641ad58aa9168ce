"""Document index, hybrid retrieval and training-data operators on PySpark."""
