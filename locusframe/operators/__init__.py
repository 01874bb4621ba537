"""Relational operators and statistical kernels, DataFrame in and DataFrame out."""
