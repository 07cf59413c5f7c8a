"""Tessera: a PySpark-native engine that compiles conversation corpora into training tables."""
