"""Data-marketplace analytics expressed as Spark DataFrame transformations."""
