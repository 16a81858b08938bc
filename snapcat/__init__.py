"""snapcat: snapshot catalogs, deduplication, pack planning and integrity as DataFrame transformations."""

__version__ = "0.1.0"
