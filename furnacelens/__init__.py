"""Safety-telemetry analytics for Spark: operators take DataFrames and return DataFrames."""

__version__ = "0.1.0"
