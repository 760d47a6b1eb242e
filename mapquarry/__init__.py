"""mapquarry: a PySpark-native engine for map extracts and the tables around them."""
