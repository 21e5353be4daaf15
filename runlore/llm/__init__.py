"""Operators of a training-data pipeline: one module per operator, registered in ``queries``."""
