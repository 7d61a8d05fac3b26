"""Provenia streaming."""
