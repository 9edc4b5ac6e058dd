"""Readers of inputs and writers of results."""
