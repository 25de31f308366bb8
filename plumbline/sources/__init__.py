"""Readers, writers and registries."""
