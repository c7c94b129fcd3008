"""Relational operators over entries, histories, devices and control events."""
