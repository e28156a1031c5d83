"""barlake: market-data analytics as PySpark DataFrame operators."""
