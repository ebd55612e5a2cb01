"""Operators of a training-data pipeline. Nothing outside this folder imports it.

Python workers import this package, so a cluster job ships it with ``--py-files``.
"""
