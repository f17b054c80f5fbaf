"""Databases as folders of tables, and where changes go."""
