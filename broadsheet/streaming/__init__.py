"""Restartable appends."""
