"""PySpark-native analytics of source-control data."""
