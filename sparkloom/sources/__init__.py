"""Readers and keyed stores."""
