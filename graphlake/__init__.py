"""graphlake: a property-graph storage and analytics engine on Spark DataFrames."""

__version__ = "0.1.0"
