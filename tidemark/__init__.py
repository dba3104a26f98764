"""A PySpark-native analytics engine: relational and time-series operators, streams, and training-data operators."""
