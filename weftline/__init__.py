"""weftline: a PySpark-native engine for declarative data integration."""

__all__ = ["__version__"]
__version__ = "0.1.0"
