"""PySpark-native engine that turns corpora of HTML pages into layered, compact documents and answers questions over them."""

__version__ = "0.1.0"
