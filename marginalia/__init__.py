"""marginalia: DataFrame operators for large collections of annotated documents."""

__version__ = "0.1.0"
