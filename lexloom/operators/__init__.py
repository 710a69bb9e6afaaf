"""Operators by area."""
