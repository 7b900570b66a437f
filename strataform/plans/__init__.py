"""Schemas and the registered queries."""
