"""Spark-native audio-fingerprint analytics."""
