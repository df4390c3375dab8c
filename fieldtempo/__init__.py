"""Field-team pace analytics expressed as PySpark DataFrame transformations."""
