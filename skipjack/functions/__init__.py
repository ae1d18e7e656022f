"""Subpackage of skipjack."""
