"""A PySpark-native analytics engine for a utility's readings, outages, customers and bills."""

__version__ = "0.1.0"
