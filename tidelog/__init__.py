"""Change-feed analytics on Spark: decode, filter, route and recover ordered logs of row changes."""

__version__ = "0.1.0"
