"""Retention and secret-exposure jobs for PySpark."""
