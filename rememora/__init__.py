"""Rememora: conversation memory retrieval and evaluation on Spark DataFrames."""

from rememora.params import Params

__all__ = ["Params"]
__version__ = "0.1.0"
