"""A PySpark-native analytics engine for maritime and ocean-economy data."""
