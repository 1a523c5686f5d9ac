"""Batch operators applied to data that keeps arriving."""
