"""Loomwork functions."""
