"""Operators over series and compressed series."""
