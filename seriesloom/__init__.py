"""seriesloom: daily asset-price panels on Spark DataFrames."""

__version__ = "0.1.0"
