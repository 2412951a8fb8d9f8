"""A PySpark-native engine for selective prediction and training-data analytics."""
