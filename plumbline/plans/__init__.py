"""Registered queries over the standard tables, each with its SQL."""
