"""Operators over the inventory, the policy table and text."""
