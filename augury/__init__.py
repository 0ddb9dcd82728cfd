"""Prediction-market analytics on Spark, and operators for training data beside it."""

__version__ = "0.1.0"
