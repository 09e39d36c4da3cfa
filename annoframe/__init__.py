"""DataFrame operators for leak-safe evaluation of models on annotated sequences."""

__version__ = "0.1.0"
