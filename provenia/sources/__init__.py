"""Provenia sources."""
