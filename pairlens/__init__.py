"""Contrastive text evaluation as PySpark DataFrame functions."""
