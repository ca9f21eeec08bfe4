"""A PySpark-native engine for banks of question-like items."""
