"""Operators for training-data pipelines: one module per operator, their queries in ``queries``."""
