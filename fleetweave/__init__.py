"""fleetweave: a Spark-native engine for device-inventory analytics and entity resolution."""

__version__ = "0.1.0"
