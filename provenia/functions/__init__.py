"""Provenia functions."""
