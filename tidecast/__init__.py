"""tidecast: daily-series counting, cleaning, features, backtests and forecasts on Spark."""

__version__ = "0.1.0"
