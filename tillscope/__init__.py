"""Retail customer and basket analytics on Spark.

Every operator is a plain function from DataFrame to DataFrame. Nothing is
executed until the caller runs an action, except for the few operators whose
docstring says that they materialise an intermediate table or fit a model.
"""

__version__ = "0.1.0"
