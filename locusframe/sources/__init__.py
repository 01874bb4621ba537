"""Readers of the exchange formats."""
