"""gridloom: a PySpark-native analytics engine for gridded imagery and derived maps."""
