"""Whole rounds as DataFrame programs."""
