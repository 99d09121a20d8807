"""Readers of trades."""
