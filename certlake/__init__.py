"""Certificate Transparency analytics as Spark DataFrame transformations."""
