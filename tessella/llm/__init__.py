"""Operators for training-data pipelines over text, pages and conversations.

The subpackage is self-contained: nothing else in the library imports it, and
it imports nothing from the rest of the library.
"""
