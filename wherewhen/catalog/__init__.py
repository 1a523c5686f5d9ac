"""Registered queries over the TPC-H-like tables, with their SQL counterparts."""
