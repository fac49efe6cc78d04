"""Operators over event tables and annotation tables."""
