"""ledgerloom: accounting analytics for many companies at once, as Spark jobs."""

__version__ = "0.1.0"
