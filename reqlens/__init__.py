"""Service-request analytics as plain PySpark DataFrame transformations."""

__version__ = "0.1.0"
