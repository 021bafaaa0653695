"""Reusable jobs over commerce tables."""
