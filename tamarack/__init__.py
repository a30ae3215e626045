"""tamarack: text-corpus analytics and ranked retrieval on Spark DataFrames."""

__version__ = "0.1.0"
