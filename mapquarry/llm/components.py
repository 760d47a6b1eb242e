"""Connected components of an edge table: the library's distributed union-find."""

from mapquarry.operators.components import components

__all__ = ["components"]
