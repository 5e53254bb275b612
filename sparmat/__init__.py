"""sparmat: a PySpark-native engine for annotated sparse matrices and genomic intervals.

Every operator takes DataFrames and returns a lazy DataFrame; nothing is collected unless the
docstring says so and states the bound.
"""

__version__ = "0.1.0"
