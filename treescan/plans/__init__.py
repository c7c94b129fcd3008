"""Whole scans, and the catalogue of queries."""
