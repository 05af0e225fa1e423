"""keelson: continuous queries, temporal preferences and sequence analytics as plain Spark plans."""

__version__ = "0.1.0"
