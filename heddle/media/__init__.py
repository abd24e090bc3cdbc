"""Numpy kernels on decoded RGBA frames, and their Arrow operators."""
