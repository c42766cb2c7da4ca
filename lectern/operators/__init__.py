"""Relational operators built from DataFrame expressions."""
