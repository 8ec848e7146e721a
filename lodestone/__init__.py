"""lodestone: retrieval and evaluation analytics as PySpark plans."""

__version__ = "0.1.0"
