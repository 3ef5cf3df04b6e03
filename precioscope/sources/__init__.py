"""Captured pages and readings in; tables, exports and state out."""
