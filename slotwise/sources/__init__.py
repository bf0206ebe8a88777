"""Readers, the source registry, and writers."""
