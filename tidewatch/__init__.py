"""tidewatch: drift and temporal-validity analytics for timestamped flow tables."""

__version__ = "0.1.0"
