"""Orrery: a PySpark-native analytics engine for world snapshots, event history and text corpora."""
