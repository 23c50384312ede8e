"""rillcube: event streams and log lines into mergeable cubes, on PySpark DataFrames.

Every operator is a lazy ``DataFrame -> DataFrame`` function.  See README.md for the map of modules.
"""

__version__ = "0.1.0"
