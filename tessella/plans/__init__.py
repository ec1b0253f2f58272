"""Registered queries and the plans they are built from."""
