"""Perturbation-screen analytics on Spark DataFrames."""

from .screen import Screen

__all__ = ["Screen"]
