"""Operators of a training-data pipeline: tokenizing, de-duplicating, scoring, mixing and searching text at scale.

Nothing outside this subpackage imports it.
"""
