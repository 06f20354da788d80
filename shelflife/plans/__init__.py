"""Whole runs made of operators, and the registered queries."""
