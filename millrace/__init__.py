"""A PySpark-native engine for dataset curation and model-evaluation queries."""
