"""Derived views that most operators read."""
