"""Operators for preparing training text at cluster scale.

Nothing else in the library imports this package; ``__spark_entry__`` adds its
queries only when it is present.
"""
