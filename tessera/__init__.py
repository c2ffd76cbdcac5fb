"""tessera: retrieval and index analytics as PySpark DataFrame pipelines."""
