"""Training-data operators on Spark: nothing else in the library imports this subpackage."""
