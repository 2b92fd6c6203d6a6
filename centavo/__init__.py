"""Small-business finance analytics as Spark jobs over canonical books."""

__version__ = "0.1.0"
