"""Loomwork streaming."""
