"""Controlled-text-generation evaluation on Spark."""
