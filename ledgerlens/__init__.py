"""Business metrics on tables, as Spark DataFrame transformations."""
