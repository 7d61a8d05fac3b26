"""Provenia operators."""
