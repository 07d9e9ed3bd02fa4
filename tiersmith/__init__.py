"""Layered-settings analytics on Spark."""
