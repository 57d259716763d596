"""latelane: order-delivery analytics for marketplaces, on Spark DataFrames."""

__version__ = "0.1.0"
