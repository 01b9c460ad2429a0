"""stationlab: daily station time-series analytics as Spark DataFrame plans."""

__all__ = ["functions", "operators", "plans", "sources", "streaming", "session", "schemas"]
