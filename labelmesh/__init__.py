"""labelmesh: multi-annotator label aggregation and inference on Spark DataFrames."""

from labelmesh.priors import Priors

__all__ = ["Priors"]
