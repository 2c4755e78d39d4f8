"""Quillon: bibliographic analytics on Spark."""
