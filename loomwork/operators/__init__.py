"""Loomwork operators."""
