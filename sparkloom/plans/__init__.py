"""Logical plans: the graph model, graphs derived from tables, degree and size reports."""
