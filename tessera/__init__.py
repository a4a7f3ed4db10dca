"""tessera: a Spark-native engine for point-in-time research over text and panel data."""

__all__ = ["session"]
