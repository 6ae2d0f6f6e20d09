"""Meridian: spatial lookup and reverse geocoding as Spark DataFrame operators."""
