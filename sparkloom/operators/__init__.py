"""Dataflow kernels and graph algorithms."""
