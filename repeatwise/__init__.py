"""Customer analytics on retail orders, as Spark DataFrame transformations."""
