"""Fixture views over the driver tables and the catalogue of named queries."""
