"""Tessella: a PySpark-native engine for evaluating vision-language question
answering and for preparing collage training data.

Nothing here holds data: each operator takes DataFrames and returns DataFrames.
"""

__version__ = "0.1.0"
