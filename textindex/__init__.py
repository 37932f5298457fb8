"""A PySpark-native engine for full-text indexes and LZ77 factorisation over tables of texts."""
