"""Adaptors from the test tables and the catalogue of queries."""
