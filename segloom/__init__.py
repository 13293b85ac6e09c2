"""Morphological-segmentation analytics on Spark DataFrames."""

__version__ = "0.1.0"


def get_version() -> str:
    """Version of the library."""
    return __version__
