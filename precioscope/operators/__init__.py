"""Relational operators over readings, offers, listings and queries."""
