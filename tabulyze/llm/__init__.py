"""Operators for cleaning and packing text collections."""
