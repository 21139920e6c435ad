"""Recollect: a PySpark-native engine for stored memory records and corpus preparation."""
