"""cellorium: a PySpark-native analytics engine for expression-style matrices.

Features by cells are held as long DataFrames with cell and feature
annotations.  Operators are declared with the DataFrame API and left to
Catalyst; Arrow batches carry the few steps that need numpy.
"""

__version__ = "0.1.0"
