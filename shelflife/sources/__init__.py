"""Readers that give the inventory and the content to be scanned."""
