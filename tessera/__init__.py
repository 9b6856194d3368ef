"""A PySpark-native engine for preparing and evaluating language-model data."""
