"""memlake: a PySpark-native memory analytics engine (see README.md)."""

__all__ = ["operators", "sources", "functions", "plans", "streaming"]
