"""Spark-native feature engine for crop, vegetation and weather data."""
