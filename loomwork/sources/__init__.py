"""Loomwork sources."""
