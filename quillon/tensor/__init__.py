"""Tensors: relational operations on DataFrames, and differentiable arrays for training."""
