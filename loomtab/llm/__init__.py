"""Operators of a training-text pipeline. Nothing else in the library imports this folder."""
