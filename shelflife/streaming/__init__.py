"""Streaming trigger."""
