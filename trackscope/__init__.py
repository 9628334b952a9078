"""trackscope: a PySpark-native analytics engine for object tracks, open-set matching and reasoning traces."""

__version__ = "0.1.0"
