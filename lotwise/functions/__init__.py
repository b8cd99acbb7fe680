"""Columns and constants that the operators share."""
