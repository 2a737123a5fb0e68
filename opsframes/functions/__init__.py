"""Reusable column expressions and parameter folding."""
