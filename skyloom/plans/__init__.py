"""Iterative plans: conjugate gradients and source fits."""
